"""Fixed values that results depend on: word lists, look-up tables, patterns and sentences. They are data, not logic."""

from __future__ import annotations

# --- letters ---
#: Vietnamese letters with diacritics, by the plain letter that replaces them.
ACCENTED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ", "d": "đ", "e": "èéẻẽẹêềếểễệ", "i": "ìíỉĩị",
    "o": "òóỏõọôồốổỗộơờớởỡợ", "u": "ùúủũụưừứửữự", "y": "ỳýỷỹỵ",
}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

# --- embedding of a text by its MD5 ---
LCG_FACTOR, LCG_STEP, LCG_SIZE, EMBEDDING_DIM = 1664525, 1013904223, 1 << 32, 64

# --- cleaning ---
CALLS_TO_ACTION = ["Toggle", r"Đăng ký(?:\s*ngay)?(?:\s*→)?", r"Khám phá thêm(?:\s*→)?", r"Tìm hiểu thêm(?:\s*→)?", r"Xem thêm(?:\s*→)?", r"Xem chi tiết(?:\s*→)?", "Tại đây", "Trở về đầu trang", "Quay lại", r"Chia sẻ(?: bài viết)?"]
CONTENTS_LINE = r"^\s*(?:#{1,6}\s*)?(?:\*\*)?Mục\s+lục(?:\*\*)?\s*$"
FILTER_LINE = r"^\s*Lọc:\s*$"
BREADCRUMB_LINE = r"^\s*Trang\s+chủ\s*[>/»]\s*.*$"
HIDDEN_EMAIL = r"\[\[email\s+protected\]\]\(/cdn-cgi/l/email-protection#[^)]*\)"
SHOWN_EMAIL = "[email protected]"
INLINE_TOGGLE = r"\[Toggle\]\(#\)"
BANNERS = ["fpt university", "trường đại học fpt"]

# --- validation ---
REQUIRED_FIELDS = ["title", "source_url", "retrieved_at", "document_version", "audience"]
AUDIENCES = ["all", "alumni", "enterprise", "faculty", "general", "parent", "prospective_student", "public", "staff", "student"]
STRICT_AUDIENCES = ["all", "faculty", "staff", "student"]
CONSISTENT_FIELDS = ["title", "source_url", "retrieved_at", "document_version", "audience", "campus", "department", "category", "language"]
REQUIRED_COLUMNS = ["doc_id", *CONSISTENT_FIELDS]
MIN_BODY = 100

# --- web pages ---
BLOCK_TAGS = ["p", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "div", "section", "article"]
SKIP_TAGS = ["script", "style", "nav", "footer", "header", "noscript", "svg", "iframe"]
NOISE_TAGS = ["script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside", "form", "button"]
NOISE_NAMES = ["breadcrumb", "share", "social", "cookie", "popup", "sidebar", "related", "recommended", "menu", "navigation", "comment", "advertisement"]
MAIN_CLASSES = ["elementor-widget-theme-post-content", "entry-content", "post-content", "td-post-content"]
MIN_PAGE, MIN_MAIN = 80, 250
MANIFEST_FIELDS = ["doc_id", "file_path", "title", "source_url", "retrieved_at", "document_version", "license_or_permission"]
METADATA_KEY = "^[a-z][a-z0-9_]*$"
NO_TITLE = "Untitled Document"

# --- headings of policy documents ---
_OPEN, _CLOSE = r"^\s*(?:#{1,6}\s+)?(?:\*\*)?\s*", r"\s*(?:\*\*)?\s*$"
CHAPTER = _OPEN + r"(CHƯƠNG\s+([IVXLCDM0-9]+)(?:[:\.\s\-]+(.*))?)" + _CLOSE
SECTION = _OPEN + r"(Mục\s+(\d+[a-zA-Z]?)(?:[:\.\s\-]+(.*))?)" + _CLOSE
ARTICLE = _OPEN + r"(Điều\s+(\d+[a-zA-Z]?)(?:[:\.\s\-]+(.*))?)" + _CLOSE
CLAUSE = _OPEN + r"(Khoản\s+(\d+[a-zA-Z]?)(?:[:\.\s\-]+(.*))?)" + _CLOSE
MARKDOWN = r"^(#{1,6})\s+(.+?)\s*$"
_PLAIN = r"^\s*(?:\*\*)?\s*"
PLAIN_CHAPTER = _PLAIN + r"(CHƯƠNG\s+[IVXLCDM0-9]+.*)" + _CLOSE
PLAIN_SECTION = _PLAIN + r"(Mục\s+\d+.*)" + _CLOSE
PLAIN_ARTICLE = _PLAIN + r"(Điều\s+\d+[a-zA-Z]?[\.\s:].*)" + _CLOSE

# --- questions: kinds ---
PROCEDURAL = ["làm thế nào", "cách", "thủ tục", "quy trình", "hướng dẫn", "đăng ký", "nộp", "xin", "phải làm gì", "bước", "cần làm", "liên hệ", "gửi", "khai báo", "yêu cầu"]
FACTUAL = ["bao nhiêu", "là gì", "mấy", "khi nào", "ở đâu", "ai", "điểm", "tín chỉ", "học phí", "hạn", "thời gian", "điều kiện", "quy định", "yêu cầu"]
CONNECTORS = [" và ", " rồi ", " sau đó ", " nếu ", " thì ", " đồng thời ", " vừa ", " cùng lúc "]
GLOBAL = ["tổng quan", "tất cả", "toàn bộ", "liệt kê", "danh sách", "so sánh", "khác nhau", "giống nhau"]
SCOPE = ["fpt", "đại học", "trường", "sinh viên", "học phần", "tín chỉ", "gpa", "ojt", "học bổng", "học phí", "ký túc", "thư viện", "campus", "fap", "bảo lưu", "thực tập", "tốt nghiệp", "điểm", "phúc khảo"]
#: In order: the first keyword that a question holds decides.
AUDIENCE_OF = {"sinh viên": "student", "giảng viên": "faculty", "nhân viên": "staff", "giáo viên": "faculty", "thầy": "faculty", "cô": "faculty"}
DEPARTMENT_OF = {"học phí": "finance", "tài chính": "finance", "học bổng": "scholarship", "ojt": "ojt", "thực tập": "ojt", "trao đổi": "international", "quốc tế": "international", "exchange": "international"}
CATEGORY_OF = {"quy chế": "academic_regulation", "quy định": "academic_regulation", "điều": "academic_regulation", "học phí": "tuition", "học bổng": "scholarship", "ojt": "ojt", "thực tập": "ojt", "trao đổi": "international_exchange", "cơ sở": "campus_services", "phòng": "support_routing", "ban": "support_routing", "liên hệ": "support_routing"}
CAMPUS_WORDS, CAMPUS = ["hcm", "hồ chí minh"], "hcm"
SEMESTERS, SEMESTER_ENTITY = ["fall", "spring", "summer"], "học kỳ"
ARTICLE_ENTITY, NUMBER_ENTITY = r"điều\s+(\d+)", r"(\d+(?:\.\d+)?)\s*(?:tín chỉ|điểm|gpa)"

# --- questions: rewriting, in order of application ---
FORMAL_SHORT = {"trượt môn": "không đạt học phần", "rớt": "không đạt", "thi lại": "thi kết thúc học phần lần 2", "học lại": "đăng ký học lại học phần không đạt", "bảo lưu": "bảo lưu kết quả học tập", "nghỉ học": "tạm dừng học tập", "đuổi học": "buộc thôi học", "cảnh cáo": "cảnh cáo học vụ"}
FORMAL = {
    "trượt môn": "không đạt học phần bắt buộc", "trượt": "không đạt", "rớt": "không đạt", "thi lại": "thi kết thúc học phần lần 2",
    "thi trượt": "không đạt kỳ thi kết thúc học phần", "học lại": "đăng ký học lại học phần không đạt", "học cải thiện": "đăng ký học cải thiện điểm",
    "bảo lưu": "bảo lưu kết quả học tập tạm dừng học", "nghỉ học": "tạm dừng học tập xin nghỉ", "đuổi học": "buộc thôi học",
    "cảnh cáo": "cảnh cáo học vụ kết quả học tập kém", "nợ môn": "chưa hoàn thành học phần bắt buộc", "GPA thấp": "điểm trung bình tích lũy thấp cảnh cáo",
    "xin điểm": "phúc khảo bài thi kết quả học phần", "miễn môn": "miễn học phần công nhận tín chỉ", "chuyển ngành": "chuyển ngành đào tạo",
    "chuyển trường": "chuyển cơ sở đào tạo", "ra trường": "tốt nghiệp cấp bằng đại học", "intern": "thực tập OJT On-the-Job Training",
    "đi thực tập": "đăng ký OJT thực tập tại doanh nghiệp",
}
EXPANSIONS = {"học phí": ["mức thu", "đóng tiền", "tài chính", "khoản phí"], "học bổng": ["hỗ trợ tài chính", "miễn giảm", "xét duyệt"], "ojt": ["thực tập", "On-the-Job Training", "doanh nghiệp"], "tốt nghiệp": ["cấp bằng", "hoàn thành chương trình", "ra trường"], "điểm": ["kết quả học tập", "GPA", "trung bình tích lũy"], "đăng ký": ["ghi danh", "thủ tục", "quy trình"]}
ENRICHED_START, PREFIX_START = "Quy định của Đại học FPT về: ", "Quy định Đại học FPT: "
SYNONYMS = {"học phí": "chi phí đào tạo", "học bổng": "chính sách học bổng", "ojt": "thực tập doanh nghiệp", "thi lại": "học lại", "fap": "cổng thông tin đào tạo", "bảo lưu": "tạm hoãn học tập", "phúc khảo": "khiếu nại điểm thi", "điểm danh": "chuyên cần vắng học"}
#: Words a question may hold, and what stands around it in a variant if it doesn't, or if it does.
VARIANT_FRAMES = [
    {"words": ["fpt"], "lacks": ["", " Đại học FPT"], "has": ["", " cơ sở HCM"]},
    {"words": ["quy chế", "quy định"], "lacks": ["quy chế ", ""], "has": ["thủ tục quy định ", ""]},
    {"words": ["sinh viên"], "lacks": ["sinh viên ", ""], "has": ["hướng dẫn học vụ ", ""]},
]

# --- questions: decomposition ---
SPLIT_SHORT = r"(?:và|rồi|sau đó|đồng thời|nếu.*?thì)"
SPLIT_WORDS = ["và", "rồi", "sau đó", "đồng thời", "ngoài ra", "cùng lúc"]
JOINT_PATTERNS = [r"\bvà\b", r"\brồi\b", r"\bsau đó\b", r"\bđồng thời\b", r"\bnếu\s+.{5,}?\s+thì\b", r"\bvừa\s+.{5,}?\s+vừa\b", r"\bngoài ra\b", r"\bthêm vào đó\b", r"\bcùng lúc\b"]
IF_THEN = r"nếu\s+(.+?)\s+thì\s+(.+)"
JOINT_TOPICS = {"học phí": "tuition", "học bổng": "scholarship", "ojt": "ojt", "thực tập": "ojt", "bảo lưu": "preservation", "nghỉ học": "leave", "trượt": "fail", "thi lại": "retake", "tốt nghiệp": "graduation", "chuyển ngành": "transfer", "cải thiện": "improve", "phúc khảo": "review", "đăng ký": "registration"}

# --- questions: passages that stand for an answer; {} is the question ---
PASSAGES = [
    (["ojt", "thực tập", "doanh nghiệp"], "Căn cứ Quy định đào tạo và Hướng dẫn thực tập tốt nghiệp (OJT) tại Đại học FPT: Sinh viên tham gia học phần OJT phải tích lũy đủ số tín chỉ quy định của chuyên ngành, đạt chuẩn ngoại ngữ đầu ra theo lộ trình và hoàn thành tuần lễ định hướng (Orientation). Đối với vấn đề {}, sinh viên thực hiện đăng ký qua cổng thông tin và nộp hồ sơ theo đúng hạn thông báo."),
    (["học phí", "tiền học", "nộp tiền", "tài chính"], "Theo Quy định tài chính sinh viên Đại học FPT: Mức học phí từng học kỳ được quy định căn cứ theo chương trình đào tạo và lộ trình môn học. Sinh viên có nghĩa vụ hoàn tất học phí đúng thời hạn thông báo trên cổng thông tin đào tạo FAP để được xếp lớp chính thức. Về nội dung {}, sinh viên theo dõi thông báo từ phòng Kế toán."),
    (["học bổng", "xét học bổng", "duy trì học bổng"], "Căn cứ Quy chế cấp và duy trì học bổng tại Đại học FPT: Sinh viên nhận học bổng cần duy trì điểm trung bình học kỳ (GPA) và điểm rèn luyện theo ngưỡng chuẩn, không vi phạm kỷ luật và hoàn thành đầy đủ số tín chỉ mỗi kỳ. Các điều kiện và thủ tục liên quan đến {} được phòng Dịch vụ sinh viên xét duyệt hàng kỳ."),
    (["thi lại", "học lại", "phúc khảo", "điểm danh", "vắng", "chuyên cần"], "Theo Quy chế đào tạo và khảo thí Đại học FPT: Sinh viên cần tham gia tối thiểu 80% thời lượng các buổi học để đạt điều kiện chuyên cần dự thi cuối kỳ. Trường hợp chưa đạt hoặc muốn cải thiện kết quả liên quan đến {}, sinh viên nộp đơn yêu cầu trên FAP theo đúng thời hạn quy định và hoàn thành thủ tục tài chính nếu có."),
    ([], "Căn cứ Sổ tay sinh viên và Quy chế đào tạo đại học chính quy tại Đại học FPT: Nhà trường quy định chi tiết quyền lợi, điều kiện thực hiện và quy trình hỗ trợ đối với {}. Sinh viên tra cứu thông tin chính thức trên cổng thông tin đào tạo FAP và liên hệ phòng ban chức năng để được giải đáp."),
]

# --- answers ---
STOP_WORDS = ["là", "gì", "như", "thế", "nào", "bao", "nhiêu", "có", "không", "cho", "của", "tại", "ở", "và", "được", "sinh", "viên", "phải", "để", "khi", "các", "một", "những", "với", "trong", "theo", "đến", "trường"]
SYSTEM_PROMPT = (
    "Bạn là trợ lý tư vấn sinh viên chính thức của Trường Đại học FPT TP.HCM. Nhiệm vụ của bạn là giải đáp câu hỏi của sinh viên dựa HOÀN TOÀN và CHÍNH XÁC trên tài liệu được cung cấp.\n\n"
    "CÁC QUY TẮC BẮT BUỘC:\n"
    "1. Trả lời trực tiếp, đầy đủ và chính xác vào câu hỏi, nêu rõ các thông tin quan trọng.\n"
    "2. BẮT BUỘC giữ nguyên và trích dẫn đầy đủ các con số, tỷ lệ phần trăm (%), thời hạn, số ngày, số tín chỉ, mức học phí, điểm GPA, số điện thoại hotline, địa chỉ email, tên phòng ban và chức danh từ ngữ cảnh.\n"
    "3. Tuyệt đối KHÔNG tự bịa đặt, suy đoán hay sử dụng thông tin ngoài ngữ cảnh được cung cấp.\n"
    "4. Kèm trích dẫn nguồn số [1], [2] tương ứng với từng ý trả lời."
)
NO_CONTEXT = "Không tìm thấy ngữ cảnh liên quan trong cơ sở tri thức."
NO_ANSWER = "TRẢ LỜI: Xin lỗi, tôi không tìm thấy thông tin liên quan trong bộ tài liệu hiện tại để trả lời câu hỏi này."
CONTEXT_LABEL, QUESTION_LABEL, ANSWER_LABEL = "NGỮ CẢNH:\n", "CÂU HỎI: ", "TRẢ LỜI:"
NOT_FOUND = "Không tìm thấy thông tin liên quan trong cơ sở tri thức để trả lời câu hỏi này."
ANSWER_START = ("Dựa trên tài liệu quy định và chính sách chính thức của Trường Đại học FPT TP.HCM, thông tin giải đáp cho câu hỏi '", "' như sau:\n\n")
MODEL_FAILED = "Lỗi khi gọi LLM: "
CITATIONS_TITLE = "\n--- Nguồn tham khảo ---"
EMPTY_STORE, EMPTY_RESULT = "Không tìm thấy tài liệu nào trong cơ sở tri thức.", "Không tìm thấy thông tin liên quan đến câu hỏi."
AGENT_RULES = "Dựa trên các ngữ cảnh được cung cấp bên dưới, hãy trả lời câu hỏi. Trích dẫn số nguồn [1], [2], ... khi trả lời. Nếu ngữ cảnh không chứa câu trả lời, hãy nói rõ là không tìm thấy thông tin."

# --- evidence and confidence ---
NUMBER_CLAIM = r"(\d+(?:[.,]\d+)?)\s*(?:tín chỉ|điểm|%|đồng|VNĐ|triệu|học phần|tuần|ngày|tháng|năm|lần)"
ARTICLE_CLAIM, DATE_CLAIM, NUMBER = r"Điều\s+\d+[a-zA-Z]?", r"\d{1,2}/\d{1,2}/\d{4}", r"\d+(?:[.,]\d+)?"
WEIGHTS = {"result_count": 0.15, "top_score": 0.30, "score_gap": 0.10, "evidence_support": 0.30, "metadata_quality": 0.15}
RETRIEVAL_WEIGHTS = {"result_count": 0.3, "top_score": 0.5, "score_gap": 0.2}
ABSTAIN_BELOW = 0.3
ABSTAIN_REASONS = ["Quá ít kết quả tìm kiếm liên quan.", "Điểm tương đồng quá thấp.", "Thiếu bằng chứng hỗ trợ cho câu trả lời.", "Độ tin cậy tổng thể thấp."]
RETRY_OVERRIDES = {"broaden_filters": {"use_metadata_filter": False, "top_k_multiplier": 2}, "rewrite_query": {"use_query_rewrite": True, "use_multi_query": False}, "multi_query": {"use_multi_query": True, "top_k_multiplier": 1.5}, "hyde": {"use_hyde": True}}

# --- routing: strategy and flags of each kind of question ---
ROUTES = {
    "FACTUAL": {"strategy": "hybrid", "flags": ["filter"]},
    "PROCEDURAL": {"strategy": "hybrid", "flags": ["filter", "rewrite"]},
    "MULTI_HOP": {"strategy": "decomposed", "flags": ["filter", "decomposition"]},
    "GLOBAL": {"strategy": "multi_query", "flags": ["multi_query"]},
    "AMBIGUOUS": {"strategy": "multi_query", "flags": ["filter", "multi_query"]},
    "OUT_OF_SCOPE": {"strategy": "hybrid", "flags": []},
}
ROUTE_FLAGS = ["filter", "reranker", "rewrite", "multi_query", "hyde", "decomposition"]
