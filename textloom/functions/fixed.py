"""Literals that results depend on, as plain text."""

# Patterns of tokens, words and numbers.
TOKEN = r"[a-z0-9]+(?:['’][a-z0-9]+)?"
ANSWER_TOKEN = r"[a-z0-9]+"
ENGLISH_WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)?"
PLAIN_WORD = r"[A-Za-z]+"
NUMBER = r"\d+(?:[.,/%:-]\d+)*"
PHONE = r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
CITATION = r"\[(\d+)\]"

# Patterns of lines.
TOC_LINE = r"(?i)^(contents|table of contents|index)$"
TOC_ENTRY = r"\.{2,}|\s\d{1,3}\s*$"
DISCUSSION = r"(?i)input of stakeholders|analysis and conclusion|authority['’]s analysis|stakeholders submitted|stakeholders suggested"
CONTACT_LINE = r"(?i)\b(address|contact centre|contact center|contact numbers|appellate authority|registered office|customer care|telephone|fax|email)\b"
ADDRESS_LINE = r"(?i)\b(address|road|street|floor|complex|avenue|building)\b"
PAGE_NUMBER = r"(?i)^(?:(?:page|pg\.?)\s*)?\d+(?:\s*(?:of|/)\s*\d+)?[.:]?$"
NAMED_PAGE = r"(?i)^(?:page|pg\.?)\s*|\bof\b|/"
BARE_NUMBER = r"^(\d{1,4})[.:]?$"
ACT_FRAGMENT = r"(?i)^\d{1,2}\s+of\s+(?:18|19|20)\d{2}\.?$"
HEADING = r"^#{1,6}\s+(.+?)\s*#*\s*$"
DEVANAGARI = r"[\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}]"
DRAFT_NAME = r"\b(draft|consultation|recommendation)\b"

# Stop words of the answer metrics and of the support overlap.
ANSWER_STOP = "a an the of to in on for and or is are was were be been it this that with as by at from can you your i my me do does will if not no yes they their there".split()
OVERLAP_STOP = "the and that this with from have has are for you".split()

# Sentences of the prompts that the metrics look for.
ABSTENTION = "I could not find this in the provided documents."
NO_PASSAGES = "(No context passages were retrieved.)"

# Document families and their markers, first match wins.
FAMILIES = [
    ("TCCCPR", ["tcccpr"]), ("MNP", ["mnp"]), ("TCPR", ["tcpr"]), ("QOS", ["qos"]), ("KYC", ["kyc", "ekyc", "know your customer"]),
    ("COMPLAINT", ["complaint redressal"]), ("ACT", ["telecommunications act 2023"]), ("HANDBOOK", ["consumer handbook"]), ("AIRTEL", ["airtel"]), ("JIO", ["jio"]),
]

# Names that tell a document's type, and the operators whose charters are guides.
NAMED_TYPES = [("trai ekyc recommendations 2017", "recommendation"), ("trai consumer handbook 2018 english", "faq_or_guide")]
OPERATORS = ("airtel", "jio", "vi")
CHARTER_WORDS = ("charter", "chart")

# Patterns of words that extraction split.
SPACED_WORDS = r"(?<![A-Za-z])([A-Za-z]+)[ \t]+([A-Za-z]+)(?![A-Za-z])"
SPACED_HYPHEN = r"(?U)(?<![A-Za-z])([A-Za-z]+)\s*-\s*([A-Za-z]+)(?![A-Za-z])"
SPLIT_INITIAL = r"(?<![A-Za-z])([A-Z])[ \t]+([a-z]{3,})(?![A-Za-z])"
SPLIT_FINAL = r"(?<![A-Za-z])([A-Za-z]{3,})[ \t]+([a-z])(?![A-Za-z])"

# Pairs that word repair joins although a half is a common word.
COMMON_SPLITS = {("a", "s"), ("t", "he"), ("e", "mail")}
ONE_LETTER_SPLITS = {("an", "d"), ("dl", "t"), ("do", "t")}
