"""Secret scans with Spark expressions only.

Spans of three patterns (an assigned password or key, an access key id, a long hexadecimal run) are always reported.
Further spans of kind ``random`` are long tokens that a character Markov model of random strings explains better than
one of ordinary identifiers: the mean log-likelihood ratio of their transitions exceeds a threshold. Both models are over
the characters themselves and counted from a labelled sample with DataFrame operations; transitions a sample lacks get
what its transitions between kinds of characters (lower case, upper case, digits, signs) suggest. Their size is fixed by
the alphabet.

Defined results: null and empty texts hold nothing; very long texts are scanned whole; rows stay apart even if they
agree; a null id is carried along; spans that begin at the same place are in order of their kind as listed; other columns
are not looked at; an empty table gives an empty result. A sample's characters outside the alphabet count as '-', and
strings of fewer than two are ignored.
"""

from __future__ import annotations

import hashlib
import json
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import joined, matches

KINDS = ("assign", "access", "hex", "random")
#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
TOKEN = "A-Za-z0-9+/_=-"
THRESHOLD, SMOOTHING = 0.4, 10.0

#: The models' alphabet: four kinds of characters, one after another.
CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_=-")
SYMBOLS = "".join(CLASSES)
N = len(SYMBOLS)

#: Words that the labelled sample's ordinary identifiers are made of: those of code, and common ones of four languages.
WORDS = """
account action active address admin amount application archive array audit author balance batch binary block body bucket buffer build cache calculate callback cancel category
channel check child class client cluster code collection column command comment commit compile complete component config connection constant container content context control
convert cookie copy count create credential current customer data database date debug default delete delivery department description deploy detail device digest directory
display document domain download driver element email employee enable encode engine environment error event example exception execute export expression external factory
failure feature field file filter flag folder font format frame function gateway generate global graph group handler hash header height history host identity image import
index information initial input insert instance integer interface internal inventory invoice item iterator java job journal kernel key label language layer layout length
level library limit line link list listener load local location logger login machine manager mapping master match maximum measure member memory message metadata method
minimum model module monitor mouse name network node normal notification number object offset operation option order output override package page parameter parent parse
password path pattern payment percent permission person pipeline placeholder platform player plugin pointer policy position power prefix preview price primary print priority
private process product profile program project property protocol provider proxy public purchase quantity query queue random range reader receive record redirect reference
region register release remove render report request reset resource response result retry return review role root route sample schedule schema scope score screen script
search second section security select sequence serial server service session setting shadow share shipping signal simple size snapshot socket source space standard start
state static status storage stream string style subject submit subscription success summary support switch symbol system table target task template temporary terminal text
theme thread threshold time title token tool total trace track traffic transaction transfer transform translate trigger type unique update upload user utility validate value
variable vector vendor version video view visible warning weight welcome widget width window word worker wrapper write year zone
the and that have with this from they will would there their what about which when make like just know take into good some could them other than then look only come over
think also back after work first well even want because these give most through between under without another against during before however little great thing world young
knowledge management development government responsibility understanding international communication organization characteristic environmental straightforward congratulation
und der die das nicht von sich mit dem ein auf ist werden durch gegen zwischen schaft keit heit lich ung ungen Geschwindigkeit Verantwortung Wissenschaft Unternehmen Zusammenarbeit
Versicherung Entwicklung Gesellschaft Beziehung Ausbildung Arbeitsplatz Krankenhaus Bundesregierung Wirtschaft Eigentum Menschen
les des une pour que dans qui sur avec pas plus par sont cette aux leur mais entre developpement gouvernement connaissance responsable environnement organisation premiere
monde travail question toujours quelque chose maintenant pendant plusieurs
los las que del una por con para como pero mas sus este entre cuando donde sobre tambien hasta desde conocimiento desarrollo responsabilidad gobierno trabajo mundo siempre
ahora mientras nosotros ciudad persona palabra electrodomestico establecimiento afortunadamente
"""
#: Alphabets that keys are drawn from.
ALPHABETS = {
    "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "alnum": string.ascii_letters + string.digits,
    "base32": string.ascii_uppercase + "234567", "lower36": string.ascii_lowercase + string.digits, "upper36": string.ascii_uppercase + string.digits,
    "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "lower": string.ascii_lowercase, "upper": string.ascii_uppercase,
}


def ordinary() -> list[str]:
    """Identifiers as code, files and prose hold them: each word with others that its number picks, joined in one of nine styles, as it is and in either case, and pairs of them joined by their capitals; dates and numbers; runs of one character."""
    words = WORDS.split()
    out = []
    for i, word in enumerate(words):
        first, *rest = [word.lower(), *(words[(i * (7 + 6 * k) + 31 * k * k + k) % len(words)].lower() for k in (1, 2, 3))]
        camel = "".join(w.capitalize() for w in rest)
        styles = (f"{first}_{rest[0]}_{rest[1]}", first + camel, f"{first}_{rest[0]}_{rest[1]}".upper(), first + rest[0], "-".join([first, *rest]), first.capitalize() + camel, "/".join([first, *rest]), (first + rest[0] + rest[1]).upper(), first + rest[0] + rest[1])
        made = styles[i % len(styles)]
        out += [made, made.upper(), made.lower(), *(x.capitalize() + y.capitalize() for x, y in zip([first, *rest], [*rest, first], strict=True))]
    for i in range(40):
        day = f"{1990 + i}-{1 + i % 12:02}-{1 + i % 28:02}"
        numbers = (f"{words[i].lower()}-{day}", day.replace("-", "") + f"{i % 24:02}{i * 7 % 60:02}{i * 11 % 60:02}", f"{words[3 * i].lower()}_{day.replace('-', '_')}", f"item-{i:04}-{3 * i:04}-{7 * i:04}", f"{i * 1234567:020}")
        out.append(numbers[i % len(numbers)])
    return [*out, string.digits * 3, *(c * 60 for c in SYMBOLS)]


def random_strings(of_each: int = 60, length: int = 40) -> list[str]:
    """Strings of each alphabet, drawn by SHA-256."""
    drawn = lambda name, i: b"".join(hashlib.sha256(f"{name} {i} {j}".encode()).digest() for j in range(-(-length // 32)))[:length]
    return ["".join(letters[x % len(letters)] for x in drawn(name, i)) for name, letters in ALPHABETS.items() for i in range(of_each)]


def training_sample(spark: SparkSession) -> DataFrame:
    """(text, random): the ordinary identifiers and the random strings, as literals of the plan."""
    listed = lambda strings, label: spark.range(1).select(F.explode(F.split(F.lit(" ".join(strings)), " ")).alias("text"), F.lit(label).alias("random"))
    return listed(ordinary(), False).union(listed(random_strings(), True))


def codes(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, f"[^{TOKEN}]", "-"), ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)


def class_of(code: Column) -> Column:
    """struct<class, size> of the kind of a character."""
    kinds, at = None, 0
    for k, letters in enumerate(CLASSES):
        at += len(letters)
        own = F.struct(F.lit(k).alias("class"), F.lit(len(letters)).alias("size"))
        kinds = F.when(code < at, own) if kinds is None else kinds.when(code < at, own)
    return kinds


def ratios(sample: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """N*N log-likelihood ratios, random over ordinary, of a character after another; ``smoothing`` transitions are added to each character, dealt by kind."""
    c, n = codes(F.col("text")), F.length("text")
    pairs = sample.where(n > 1).select("random", F.explode(F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: a * N + b)).alias("pair"))
    every = sample.sparkSession.range(N * N).select(F.col("id").cast("int").alias("pair"), F.explode(F.array(F.lit(False), F.lit(True))).alias("random"))
    counts = every.join(pairs.groupBy("random", "pair").count(), ["random", "pair"], "left").withColumn("n", F.coalesce("count", F.lit(0)))
    counts = counts.withColumn("from", class_of(F.floor(F.col("pair") / N))).withColumn("to", class_of(F.col("pair") % N))
    total = lambda *by: F.sum("n").over(Window.partitionBy("random", *by))
    share = (total("from.class", "to.class") + 0.5) / (total("from.class") + 0.5 * len(CLASSES)) / F.col("to.size")
    logs = counts.withColumn("log_p", F.log((F.col("n") + smoothing * share) / (total(F.floor(F.col("pair") / N)) + smoothing)))
    table = logs.groupBy("pair").agg(F.sum(F.when(F.col("random"), F.col("log_p")).otherwise(-F.col("log_p"))).alias("ratio"))
    return [r.ratio for r in table.orderBy("pair").collect()]  # N * N rows


def mean_ratio(text: Column, table: Column) -> Column:
    c, n = codes(text), F.length(text)
    steps = F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: F.element_at(table, a * N + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (n - 1)


def scan(docs: DataFrame, min_length: int = 20, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", sample: DataFrame | None = None) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end, score), each by start, then kind as listed."""
    table = F.from_json(F.lit(json.dumps(ratios(sample or training_sample(docs.sparkSession)))), "array<double>")  # one literal
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    patterns = {"assign": ASSIGN, "access": rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "hex": rf"[0-9a-f]{{{LEAST['hex']},}}", "random": rf"(?<![{TOKEN}])[{TOKEN}]{{{min_length},}}"}
    for kind, pattern in patterns.items():
        df = matches(df, "t", pattern, kind)
    value = lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2))
    df = df.withColumn("assign", F.filter("assign", lambda x: value(x) >= LEAST["assign"]))
    shaped = lambda kind, k: F.transform(kind, lambda x: F.struct(x["start"], F.lit(k).alias("rank"), F.lit(kind).alias("kind"), x["end"], F.lit(None).cast("double").alias("score")))
    df = df.withColumn("base", F.sort_array(F.concat(*[shaped(kind, k) for k, kind in enumerate(KINDS[:3])])))
    scored = F.transform("random", lambda x: F.struct(x["start"], F.lit(3).alias("rank"), F.lit("random").alias("kind"), x["end"], mean_ratio(x["text"], table).alias("score")))
    free = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
    df = df.withColumn("added", F.filter(F.filter(scored, lambda x: x["score"] > threshold), free))
    return df.select("doc_id", "base", "added")


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "added"))).alias("spans"))
