"""Terms of writing systems, school levels and subjects by language.

Fixed values, defaults of parameters.
"""

# ---- fixed values: languages ----
WRITING_SYSTEMS = {"zh": "chinese_characters", "ja": "japanese_mixed", "ko": "hangul", "ar": "arabic_script", "ru": "cyrillic", "th": "thai_script", "hi": "devanagari"}
LANGUAGE_NAMES = {"zh": "Chinese", "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "ru": "Russian", "es": "Spanish", "fr": "French", "de": "German"}
RIGHT_TO_LEFT = ["ar"]
SYSTEMS = {"zh": "east_asian", "ja": "east_asian", "ko": "east_asian", "ar": "arabic"}

# ---- fixed values: school levels by system ----
SCHOOL_LEVELS = {
    "east_asian": {
        "elementary": ["小学", "초등", "小學"], "middle_school": ["中学", "중학", "中學"], "high_school": ["高中", "고등학교", "高校"], "undergraduate": ["本科", "학부", "大学"],
        "graduate": ["研究生", "대학원", "修士"], "doctoral": ["博士", "박사", "博士"],
    },
    "arabic": {
        "elementary": ["ابتدائي", "الابتدائية"], "middle_school": ["متوسط", "المتوسطة"], "high_school": ["ثانوي", "الثانوية"], "undergraduate": ["بكالوريوس", "الجامعة"],
        "graduate": ["ماجستير", "الدراسات العليا"], "doctoral": ["دكتوراه", "الدكتوراه"],
    },
    "western": {
        "elementary": ["elementary", "primary", "grade 1", "grade 2", "grade 3", "grade 4", "grade 5"], "middle_school": ["middle school", "grade 6", "grade 7", "grade 8"],
        "high_school": ["high school", "secondary", "grade 9", "grade 10", "grade 11", "grade 12"], "undergraduate": ["undergraduate", "bachelor", "college", "university"],
        "graduate": ["graduate", "master", "msc", "ma"], "doctoral": ["doctoral", "phd", "doctorate"],
    },
}

# ---- fixed values: subjects by language ----
SUBJECTS = {
    "mathematics": {
        "en": ["math", "mathematics", "algebra", "calculus", "geometry"], "zh": ["数学", "代数", "几何", "微积分"], "ja": ["数学", "代数", "幾何", "微積分"], "ko": ["수학", "대수", "기하", "미적분"],
        "ar": ["رياضيات", "جبر", "هندسة", "تفاضل"], "ru": ["математика", "алгебра", "геометрия", "исчисление"], "es": ["matemáticas", "álgebra", "geometría", "cálculo"],
        "fr": ["mathématiques", "algèbre", "géométrie", "calcul"], "de": ["mathematik", "algebra", "geometrie", "kalkül"],
    },
    "computer_science": {
        "en": ["computer", "programming", "algorithm", "software"], "zh": ["计算机", "编程", "算法", "软件"], "ja": ["コンピュータ", "プログラミング", "アルゴリズム", "ソフトウェア"],
        "ko": ["컴퓨터", "프로그래밍", "알고리즘", "소프트웨어"], "ar": ["حاسوب", "برمجة", "خوارزمية", "برمجيات"], "ru": ["компьютер", "программирование", "алгоритм", "программное обеспечение"],
        "es": ["computadora", "programación", "algoritmo", "software"], "fr": ["ordinateur", "programmation", "algorithme", "logiciel"], "de": ["computer", "programmierung", "algorithmus", "software"],
    },
}
OWN_SUBJECTS = {
    "east_asian": {"traditional_medicine": ["中医", "漢方", "한의학"], "calligraphy": ["书法", "書道", "서예"], "martial_arts": ["武术", "武道", "무술"], "confucian_studies": ["儒学", "儒教", "유교"]},
    "arabic": {"islamic_studies": ["الدراسات الإسلامية", "الفقه", "التفسير"], "arabic_literature": ["الأدب العربي", "الشعر العربي"], "islamic_law": ["الشريعة", "القانون الإسلامي"]},
    "western": {},
}
