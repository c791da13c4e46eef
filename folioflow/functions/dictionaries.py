"""Term lists, patterns and thresholds that scores are defined by.

Fixed values: results depend on each, and on their order, since the first of
equals wins. All are defaults of parameters.
"""

# ---- fixed values: educational relevance ----
RELEVANCE_TERMS = {
    "academic_terms": (1.5, [
        "course", "syllabus", "curriculum", "lecture", "tutorial", "assignment", "homework", "exam", "quiz", "test", "study", "textbook", "chapter", "lesson", "module", "unit", "semester",
        "academic", "education", "learning", "teaching", "instruction", "pedagogy", "student", "professor", "instructor", "faculty", "university", "college", "school", "department", "research",
        "thesis", "dissertation",
    ]),
    "subject_indicators": (1.2, [
        "mathematics", "physics", "chemistry", "biology", "computer science", "engineering", "history", "literature", "psychology", "sociology", "economics", "philosophy", "political science",
        "geography", "anthropology", "linguistics", "statistics", "calculus", "algebra", "geometry", "programming", "algorithms", "data structures",
    ]),
    "document_types": (1.0, [
        "notes", "slides", "presentation", "handout", "worksheet", "lab manual", "guide", "reference", "handbook", "primer", "introduction", "overview", "summary", "review", "analysis",
    ]),
}
INSTITUTIONS = [
    (1.0, ["harvard", "mit", "stanford", "cambridge", "oxford", "caltech", "princeton", "yale", "columbia", "chicago", "berkeley", "ucla"]),
    (0.7, ["university", "college", "institute", "school", "academy", "polytechnic", "technical", "state university", "community college"]),
    (0.8, ["springer", "elsevier", "wiley", "pearson", "mcgraw-hill", "cambridge university press", "oxford university press", "mit press", "academic press"]),
]
ACADEMIC_DOMAINS = [".edu", ".ac.", "university", "college", "school"]
AUTHOR_TITLES = ["dr.", "prof.", "professor", "ph.d", "phd", "md", "m.d.", "assistant professor", "associate professor", "lecturer", "researcher", "scientist", "fellow"]
COURSE_PATTERNS = [r"\b[A-Z]{2,4}\s*\d{3,4}\b", r"\b[A-Z]{2,4}-\d{3,4}\b", r"\bCourse\s+\d+\b", r"\bLecture\s+\d+\b", r"\bChapter\s+\d+\b"]
STRUCTURE_TERMS = ["table of contents", "bibliography", "references", "abstract", "introduction", "conclusion", "methodology", "results", "discussion", "appendix", "syllabus", "assignment"]

# ---- fixed values: academic level ----
LEVELS = ["high_school", "undergraduate", "graduate", "postgraduate", "unknown"]
LEVEL_TERMS = {
    "high_school": {
        "patterns": [r"\b(9|10|11|12)th\b", r"\bgrade\s*(9|10|11|12)\b", r"\bhigh\s*school\b", r"\bsecondary\b"],
        "subjects": ["algebra", "geometry", "biology", "chemistry", "physics", "world history", "us history", "english", "literature"],
        "complexity": ["basic", "introduction", "fundamentals", "overview", "beginner", "elementary", "simple"],
        "indicators": ["homework", "quiz", "test prep", "study guide", "review"],
    },
    "undergraduate": {
        "patterns": [r"\b[A-Z]{2,4}\s*[1-4]\d{2}\b", r"\bundergrad\b", r"\bbachelor\b", r"\bb\.?s\.?\b", r"\bb\.?a\.?\b"],
        "subjects": ["calculus", "statistics", "organic chemistry", "psychology", "economics", "computer science", "engineering", "sociology"],
        "complexity": ["intermediate", "analysis", "theory", "principles", "concepts", "methods", "applications"],
        "indicators": ["midterm", "final exam", "project", "lab report", "essay"],
    },
    "graduate": {
        "patterns": [r"\b[A-Z]{2,4}\s*[5-9]\d{2}\b", r"\bgrad\b", r"\bmaster\b", r"\bm\.?s\.?\b", r"\bm\.?a\.?\b", r"\bphd\b", r"\bdoctoral\b"],
        "subjects": ["advanced", "research methods", "thesis", "dissertation", "seminar", "independent study", "practicum"],
        "complexity": ["advanced", "sophisticated", "complex", "theoretical", "empirical", "methodology", "framework", "paradigm"],
        "indicators": ["research", "publication", "conference", "peer review", "citation", "bibliography"],
    },
}
LEVEL_RANGES = {"high_school": ((30, 70), (8, 12)), "undergraduate": ((10, 50), (12, 16)), "graduate": ((0, 30), (16, 25))}
EXTRACTOR_LEVEL_TERMS = {
    "high_school": [
        "high school", "secondary", "grade 9", "grade 10", "grade 11", "grade 12", "freshman year", "sophomore year", "junior year", "senior year", "ap course", "advanced placement",
        "9th grade", "10th grade", "11th grade", "12th grade",
    ],
    "undergraduate": [
        "undergraduate", "bachelor", "college", "university", "intro to", "introduction to", "fundamentals", "principles of", "basic", "survey of", "bsc", "ba", "bs", "college students",
        "university students",
    ],
    "graduate": ["graduate", "master", "masters", "msc", "ma", "ms", "advanced", "seminar", "research methods", "thesis", "graduate level", "graduate course"],
    "postgraduate": ["phd", "doctoral", "postdoc", "post-doctoral", "dissertation", "advanced research", "ph.d", "doctorate", "postgraduate"],
}

# ---- fixed values: subjects and topics ----
SUBJECT_TERMS = {
    "computer_science": [
        "algorithm", "programming", "software", "computer", "data structure", "machine learning", "artificial intelligence", "database", "network", "cybersecurity", "web development", "python",
        "java", "javascript",
    ],
    "mathematics": ["calculus", "algebra", "geometry", "statistics", "probability", "differential", "integral", "matrix", "theorem", "proof", "equation", "function", "derivative", "limit"],
    "physics": ["mechanics", "thermodynamics", "electromagnetism", "quantum", "relativity", "wave", "particle", "energy", "force", "motion", "field", "radiation", "optics", "nuclear"],
    "chemistry": ["molecule", "atom", "reaction", "compound", "element", "organic", "inorganic", "biochemistry", "catalyst", "bond", "periodic table", "solution", "acid", "base"],
    "biology": ["cell", "genetics", "evolution", "ecology", "anatomy", "physiology", "molecular biology", "organism", "species", "dna", "rna", "protein", "enzyme", "metabolism"],
    "engineering": [
        "design", "system", "mechanical", "electrical", "civil", "chemical engineering", "materials", "manufacturing", "control", "optimization", "simulation", "modeling", "analysis",
    ],
    "business": [
        "management", "marketing", "finance", "economics", "accounting", "strategy", "leadership", "organization", "entrepreneurship", "investment", "market", "business model", "revenue",
    ],
    "psychology": ["behavior", "cognitive", "social psychology", "development", "personality", "learning", "memory", "perception", "emotion", "therapy", "mental health", "research methods"],
    "history": ["historical", "ancient", "medieval", "modern", "civilization", "culture", "society", "political", "economic history", "war", "revolution", "empire", "dynasty"],
    "literature": ["novel", "poetry", "drama", "literary analysis", "author", "narrative", "character", "theme", "symbolism", "criticism", "genre", "style", "rhetoric", "composition"],
}
SUBJECT_HINTS = {
    "mathematics": ["math", "mathematics", "calculus", "algebra", "geometry", "statistics"],
    "computer_science": ["computer", "programming", "software", "algorithm", "data structure"],
    "physics": ["physics", "quantum", "mechanics", "electromagnetic", "thermodynamics"],
    "chemistry": ["chemistry", "chemical", "organic", "inorganic", "molecular"],
    "biology": ["biology", "biological", "genetics", "ecology", "molecular biology"],
    "engineering": ["engineering", "mechanical", "electrical", "civil", "design"],
    "business": ["business", "management", "finance", "marketing", "economics"],
}
_HU, _UG = ["high_school", "undergraduate"], ["undergraduate", "graduate"]
#: (subject, topic, terms, levels), in order.
TAXONOMY = [
    ("mathematics", "calculus", ["calculus", "derivative", "integral", "limit", "differential", "multivariable"], _HU),
    ("mathematics", "algebra", ["algebra", "linear", "matrix", "vector", "polynomial", "equation"], _HU),
    ("mathematics", "statistics", ["statistics", "probability", "distribution", "hypothesis", "regression", "analysis"], _UG),
    ("mathematics", "discrete_math", ["discrete", "combinatorics", "graph theory", "logic", "proof", "set theory"], _UG),
    ("computer_science", "programming", ["programming", "coding", "python", "java", "javascript", "algorithm", "data structure"], _HU),
    ("computer_science", "machine_learning", ["machine learning", "neural network", "deep learning", "ai", "artificial intelligence"], _UG),
    ("computer_science", "databases", ["database", "sql", "nosql", "data modeling", "query", "relational"], _UG),
    ("computer_science", "software_engineering", ["software engineering", "design patterns", "architecture", "testing", "agile"], _UG),
    ("computer_science", "cybersecurity", ["security", "cryptography", "encryption", "cybersecurity", "network security"], _UG),
    ("physics", "mechanics", ["mechanics", "motion", "force", "energy", "momentum", "kinematics"], _HU),
    ("physics", "electromagnetism", ["electromagnetic", "electric", "magnetic", "field", "wave", "maxwell"], _UG),
    ("physics", "quantum_physics", ["quantum", "particle", "wave function", "uncertainty", "schrodinger"], _UG),
    ("physics", "thermodynamics", ["thermodynamics", "heat", "temperature", "entropy", "gas laws"], _UG),
    ("chemistry", "organic_chemistry", ["organic", "carbon", "hydrocarbon", "functional group", "synthesis", "reaction mechanism"], _UG),
    ("chemistry", "inorganic_chemistry", ["inorganic", "metal", "coordination", "crystal", "solid state"], _UG),
    ("chemistry", "physical_chemistry", ["physical chemistry", "thermochemistry", "kinetics", "spectroscopy", "quantum chemistry"], _UG),
    ("biology", "molecular_biology", ["molecular", "dna", "rna", "protein", "gene", "genetics"], _UG),
    ("biology", "ecology", ["ecology", "ecosystem", "environment", "biodiversity", "conservation"], _HU),
    ("biology", "cell_biology", ["cell", "cellular", "membrane", "organelle", "mitosis", "meiosis"], _HU),
    ("engineering", "mechanical_engineering", ["mechanical", "thermodynamics", "fluid mechanics", "materials", "design"], _UG),
    ("engineering", "electrical_engineering", ["electrical", "circuit", "electronics", "signal processing", "control systems"], _UG),
    ("engineering", "civil_engineering", ["civil", "structural", "construction", "infrastructure", "concrete", "steel"], _UG),
    ("business", "management", ["management", "leadership", "strategy", "organization", "planning"], _UG),
    ("business", "finance", ["finance", "investment", "accounting", "financial", "money", "capital"], _UG),
    ("business", "marketing", ["marketing", "advertising", "brand", "consumer", "market research"], _UG),
]
SOURCE_SUBJECTS = {
    "computer_science": ["computer science", "cs", "programming", "software", "algorithm"],
    "mathematics": ["mathematics", "math", "calculus", "algebra", "statistics"],
    "physics": ["physics", "quantum", "mechanics", "thermodynamics"],
    "engineering": ["engineering", "mechanical", "electrical", "civil"],
    "biology": ["biology", "genetics", "molecular", "biochemistry"],
    "chemistry": ["chemistry", "organic", "inorganic", "chemical"],
    "economics": ["economics", "finance", "business", "management"],
}
CATEGORY_PREFIXES = [
    ("cs.", "computer_science"), ("math.", "mathematics"), ("physics.", "physics"), ("stat.", "statistics"), ("econ.", "economics"), ("q-bio.", "biology"), ("cond-mat.", "physics"),
    ("astro-ph.", "astronomy"), ("hep-", "physics"), ("nucl-", "physics"), ("quant-ph", "physics"),
]
SCRIPTED_PAGES, SERVICE_PAGES = ["react", "angular", "vue", "spa-", "single-page"], ["api/", "/api", "rest", "json", "xml"]
SOURCE_DOMAINS = [".edu", ".ac.", "university", "college", "institute", "arxiv", "researchgate"]

# ---- fixed values: grouping ----
COURSE_CODES = [r"[A-Z]{2,4}\s*\d{3,4}[A-Z]?", r"[A-Z]{2,4}-\d{3,4}", r"\d{1,2}\.\d{3}"]
SERIES_PATTERNS = [r"(.+?)\s+(?:part|volume|chapter|section)\s+(\d+)", r"(.+?)\s+(\d+)\s*(?:of\s*(\d+))?", r"(.+?)\s*-\s*(\d+)", r"(.+?)\s*\(\s*(\d+)\s*\)"]
STOP_WORDS = ["the", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by"]
MATERIALS = [
    ("lectures", ["lecture", "slides", "presentation", "notes", "chapter"]),
    ("assignments", ["assignment", "homework", "exercise", "problem set", "lab"]),
    ("exams", ["exam", "test", "quiz", "midterm", "final", "solution"]),
    ("textbooks", ["textbook", "book", "manual", "guide", "handbook"]),
]

# ---- fixed values: URLs ----
PAGE_EXTENSIONS = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".zip", ".tar", ".gz"]
PAGE_SKIPS = ["/admin", "/login", "/logout", "/search", "/api/", "?download="]
CRAWL_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".zip", ".tar", ".gz", ".rar", ".7z", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".mp3", ".mp4", ".avi", ".mov", ".wmv",
    ".exe", ".dmg", ".pkg",
]
CRAWL_SKIPS = [
    "/admin", "/login", "/logout", "/register", "/signup", "/search", "/api/", "/ajax/", "/json/", "/xml/", "/feed/", "/rss/", "/atom/", "?download=", "?action=", "?cmd=", "/cgi-bin/",
    "/scripts/", "/includes/",
]
ACADEMIC_PATHS = {
    "course_pages": ["/courses?/", "/classes?/", "/subjects?/", "/curriculum/", "/academics?/", "/teaching/", "/syllabi?/", "/course[-_]?materials?/"],
    "faculty_directories": ["/faculty/", "/staff/", "/people/", "/directory/", "/professors?/", "/instructors?/", "/researchers?/"],
    "department_pages": ["/departments?/", "/schools?/", "/colleges?/", "/divisions?/", "/programs?/", "/majors?/"],
    "resource_pages": ["/resources?/", "/materials?/", "/downloads?/", "/publications?/", "/papers?/", "/documents?/", "/library/", "/archives?/"],
    "lecture_materials": ["/lectures?/", "/notes?/", "/slides?/", "/presentations?/", "/handouts?/", "/assignments?/", "/homework/", "/exercises?/"],
}
ACADEMIC_URL_TERMS = [
    "course", "class", "lecture", "syllabus", "assignment", "homework", "exam", "quiz", "project", "lab", "research", "publication", "paper", "thesis", "faculty", "professor", "instructor",
    "student",
]
PRIORITY_PATHS = [
    (10, ["/courses?/", "/classes?/", "/lectures?/", "/materials?/", "/resources?/", "/downloads?/"]),
    (5, ["/departments?/", "/faculty/", "/research/", "/publications?/", "/papers?/"]),
]
NO_PDF_LINK = ["javascript:", "mailto:", "#", "tel:"]
PDF_URL_TERMS = [".pdf?", ".pdf#", "/pdf/", "download.pdf", "arxiv.org/pdf/", "arxiv.org/abs/"]
PDF_QUERY_TERMS = ["filetype=pdf", "type=pdf", "format=pdf"]

# ---- fixed values: operations ----
ERROR_NAMES = [
    ("ConnectionError", "network", "medium"), ("TimeoutError", "timeout", "medium"), ("ConnectTimeout", "timeout", "medium"), ("ReadTimeout", "timeout", "low"), ("DNSError", "network", "high"),
    ("SSLError", "network", "high"), ("ClientResponseError", "network", "medium"), ("ServerDisconnectedError", "network", "medium"), ("UnicodeDecodeError", "content", "low"),
    ("JSONDecodeError", "content", "low"), ("ParseError", "content", "low"), ("MemoryError", "processing", "critical"), ("ProcessingError", "processing", "medium"),
    ("PermissionError", "storage", "high"), ("FileNotFoundError", "storage", "medium"), ("OSError", "storage", "medium"), ("TooManyRequests", "rate_limit", "low"), ("RateLimitError", "rate_limit", "low"),
]
ERROR_WORDS = [
    (["timeout", "timed out"], "timeout", "medium"), (["connection", "network", "dns"], "network", "medium"), (["permission", "access denied"], "storage", "high"),
    (["memory", "out of memory"], "processing", "critical"),
]
RECOVERY = {
    "network": "retry", "timeout": "retry", "rate_limit": "pause", "content": "skip", "processing": "fallback", "storage": "retry", "authentication": "abort", "unknown": "retry",
}
SEVERITIES = ["info", "warning", "error", "critical"]

# ---- fixed values: languages told by their academic words ----
LANGUAGE_TERMS = {
    "zh": ["大学", "学院", "研究", "论文", "学术", "教育", "课程"],
    "ja": ["大学", "学校", "研究", "論文", "学術", "教育", "講義"],
    "ko": ["대학교", "대학", "연구", "논문", "학술", "교육", "강의"],
    "ar": ["جامعة", "كلية", "بحث", "دراسة", "أكاديمي", "تعليم", "محاضرة"],
    "ru": ["университет", "институт", "исследование", "статья", "академический", "образование", "лекция"],
    "es": ["universidad", "instituto", "investigación", "artículo", "académico", "educación", "conferencia"],
    "fr": ["université", "institut", "recherche", "article", "académique", "éducation", "conférence"],
    "de": ["universität", "institut", "forschung", "artikel", "akademisch", "bildung", "vorlesung"],
}
LINK_EXCLUDES = {
    "zh": ["广告", "商业", "购买"], "ja": ["広告", "商業", "購入"], "ko": ["광고", "상업", "구매"], "ar": ["إعلان", "تجاري", "شراء"], "ru": ["реклама", "коммерческий", "покупка"],
    "es": ["publicidad", "comercial", "comprar"], "fr": ["publicité", "commercial", "acheter"], "de": ["werbung", "kommerziell", "kaufen"],
}


#: English stop words: fixed values, the list of Spark's own StopWordsRemover.
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these
    those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
    can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
    haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()

# ---- fixed values of page and file metadata ------------------------------

PDF_PATTERNS = [
    r"""(?i)href=["']([^"']*\.pdf[^"']*)["']""", r"""(?i)href=["']([^"']*filetype[=:]pdf[^"']*)["']""", r"""(?i)href=["']([^"']*\.pdf\?[^"']*)["']""", r"""(?i)src=["']([^"']*\.pdf[^"']*)["']""",
    r"""(?i)(https?://[^\s<>"']*\.pdf[^\s<>"']*)""", r"""(?i)(https?://[^\s<>"']*filetype[=:]pdf[^\s<>"']*)""",
]
LINK_WORDS = [
    "lecture", "notes", "slides", "handout", "assignment", "homework", "exam", "quiz", "solution", "textbook", "chapter", "paper", "publication", "research", "thesis", "dissertation", "report",
]
AUTHOR_PATTERNS = [r"(?i)(?:by|author|instructor):\s*([^<>\n]+)", r"(?i)(?:prof|professor|dr)\.?\s+([^<>\n]+)"]
#: (word that must occur, pattern)
INSTITUTION_PATTERNS = [
    (" university", r"(?i)([^<>\n]+ university)"), (" college", r"(?i)([^<>\n]+ college)"), (" institute", r"(?i)([^<>\n]+ institute)"), ("university of ", r"(?i)university of ([^<>\n]+)"),
]
TITLE_SKIPS = ["page", "chapter", "section", "figure", "table"]
PATH_SUBJECTS = [("computer_science", ["computer", "cs"]), ("mathematics", ["math"]), ("physics", ["physics"])]
NAME_KEYWORDS = [("lecture", ["lecture", "course material"]), ("tutorial", ["tutorial", "learning"]), ("assignment", ["assignment", "homework"]), ("exam", ["exam", "test"])]
