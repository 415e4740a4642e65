"""Patterns, word lists, tables and formats that results depend on.

They must stay as they are for results to agree with earlier reports.
"""

# Months, by name and short name.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}

UNKNOWN = "UNKNOWN"
NO_VALUE = "—"

# Index lines.
DATE_LINE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
PAGE_START = r"^[\d\-,\s]"
PAGES_ONLY = r"^[\d\-,\s]+$"
GLUED_PAGES = r"^([\d\-,]+)([A-Z][a-z]+.*)$"
SLASH_DIGITS = r"\d+/\d+"
UNDATED = "Undated"
# Cells of a pipe-drawn index.
FIRST_CELL = r"^\|\s*([^|]*?)\s*\|"
THIRD_CELL = r"\|\s*[^|]*\|\s*[^|]*\|\s*([^|]+)\|"
LAST_CELL = r"\|\s*([\d,\s\-]+)\s*\|?\s*$"
TABLE_RULE = r"^\+[-+]+\+"
NEXT_DATE = r"^\|\s*\d{1,2}/"
WRITTEN_CELL = r"(?i)^(" + "|".join(MONTHS) + r")\s+(\d{1,2}),\s+(\d{4})$"
# Links.
LINK_RANGE = r"^(\d+)\s*-\s*(\d+)$"
# Prompts of letters.
# A value may stand on a later line than its label; a line ends at \n only.
PROMPT_PAGE = r"(?dmi)^-\s*Page:\s*(\d+)"
PROMPT_PAGES = r"Pages in document:\s*(\d+)"
PROMPT_SUBCATEGORY = r"(?d)Sub-category:\s*(.+)"
PROMPT_LABEL = r"(?dm)^{label}:\s*([^\n]+)"
PROMPT_DATES = ("Date", "Encounter Date", "Letter Date")
HEADER_LINES = 5
HEADER_LENGTH = 150
LAST_PAGE = 500
INDEX_PDF_PAGES = 25

# Section headers of plain documents.
SECTION_LINE = r"^§\s*(.+)$"
SECTION_SKIP = ("Category:", "Sub-category:")
UNKNOWN_DATE = "Unknown Date"
SECTION_FORMS = (
    r"^(Unknown Date),\s*(.+)$",
    r"^([A-Z][a-z]+\s+\d{1,2},\s+\d{4}),\s*(.+)$",
    r"^([A-Z][a-z]+\s+\d{1,2},\s+\d{4})\s+(.+)$",
    r"^(\d{1,2}/\d{1,2}/\d{2,4}),\s*(.+)$",
    r"^(\d{1,2}/\d{1,2}/\d{2,4})\s+(.+)$",
    r"^([^,]+),\s*(.+)$",
)

VENDOR_HEADER = r"^(.+?(?:,\s*Inc\.|,\s*LLC)?),\s+([^,]+(?:,\s*(?:MD|DO|PA|NP|DC|DDS|PhD|PsyD))?),\s+(.+),$"
VENDOR_DATE = r"^(\d{1,2}/\d{1,2}/\d{2,4})$"
VENDOR_COVER = r"(?i)^Cover letter.+dated\s+(\d{1,2}/\d{1,2}/\d{4})"
VENDOR_INLINE = r"^(.+?),\s+(\d{1,2}/\d{1,2}/\d{2,4})$"

# Page text and similarity.
PREVIEW_CHARS, FULL_CHARS = 201, 501
PAGE_DATES = r"\d{1,2}/\d{1,2}/\d{2,4}"
PAGE_PROVIDERS = r"\w+(?:,?\s+(?:md|do|pa|np|dc|dds|phd|psyd))"
PAGE_TERMS = r"(?:office visit|x-ray|mri|therapy|report|encounter|consultation|examination|treatment)"
WEIGHTS = {"dates": 3.0, "providers": 2.0, "preview": 1.0, "terms": 1.0, "full": 2.0}
REPORT_CONFIDENCE = ((0.7, "STRONG"), (0.5, "LIKELY"), (0.3, "WEAK"))
PAIR_CONFIDENCE = ((0.8, "SAME DOCUMENT"), (0.5, "LIKELY SAME"), (0.3, "WEAK MATCH"))
PAIR_OTHERWISE = "DIFFERENT DOCUMENTS"
NO_MATCH = "NO MATCH"
SEARCH_SCORE, DUPLICATE_SCORE, TOP_CANDIDATES = 0.5, 0.98, 3
PAGE_STAMP = r"Actual Page No\.\s*(\d+)"

# Letters.
CREDENTIALS = r"(?i),?\s*\(?(?:MD|DO|DC|PhD|PsyD|LCSW|MFT|NP|PA|Esq\.?|Jr\.?|Sr\.?|III?|IV|D\.?C\.?|M\.?D\.?|D\.?O\.?)\)?\b"
ORGANISATIONS = r"(?i)\b(LLC|LLP|Inc|Corp|Corporation|Administration|Department|City of|County of|Permanente|Associates|Foundation|University|Hospital|Medical Center|Clinic|Health\s+(?:System|Plan|Group)|Group|Services|Federal)\b"
HEADER_DATE_BRACKET = r"(?i)\[([A-Z][a-z]+ \d{1,2},? \d{4})"
HEADER_DATE_UNKNOWN = r"(?i)\[Unknown[,\s]"
HEADER_DATE_PLAIN = r"(?i)^#?\s*([A-Z][a-z]+ \d{1,2},? \d{4})"
HEADER_BRACKET = r"(?i)\[(.+)\]\{\.underline\}"
HEADER_COVER = r"(?i)Cover Letter - (.+)$"
HEADER_SHAPE = r"^#\s*\[.+\]\{\.underline\}"
LABELLED_DATE = r"(?i)(?:date of service|(?<!\w)dos(?!\w)|encounter date|service date|exam date|visit date|appointment date|appointment|date of exam|date of visit|date of evaluation|evaluation date)[:\s]{0,10}(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|[A-Z][a-z]+\.?\s+\d{1,2},?\s+\d{4})"
CLINICAL_FIELDS = (
    "diagnosis", "findings", "procedures", "medications", "impression", "assessment",
    "treatment", "symptoms", "complaints", "history_of_present_illness",
    "functional_capacity", "restrictions", "work_status",
)
CLINICAL_CHARS, PHRASE_WORDS = 20, 3
CHARS_PER_PAGE = 20
SIMILAR_CHARS, SIMILAR_COSINE, EXCLUSIVE_CHARS = 50, 0.90, 200
SCORE_CHECKS = ("header_format", "date_consistency", "provider_consistency", "empty_content", "required_sections", "content_length")
SECTION_NAMES = {
    "Assessment": ("Assessment", "Impression", "Diagnosis", "Diagnoses"),
    "Subjective": ("Subjective", "Chief Complaint", "HPI", "History of Present Illness"),
    "Findings": ("Findings", "Results"),
    "Conclusion": ("Conclusion", "Summary", "Interpretation"),
    "Impairment": ("Impairment", "Disability", "WPI"),
}

# Rubrics: the header shape that matters, and required sections, by subcategory.
EVALUATION = "QME (Qualified Medical Evaluation), AME (Agreed Medical Examination), Panel QME Reports in Psychology, Panel QME Reports from Non-Psychiatric Specialists, Supplementals and QMEs from mental health professionals, Non-psych reports Supplementals AME QME"
RUBRICS = {
    "Reports by Psychologists, Psychiatrists, Neuropsychologists": ("clinical", ("Subjective", "Assessment")),
    "Progress Notes and Reports by Treating Physicians": ("clinical", ("Subjective", "Assessment")),
    "Diagnostic Studies (X-rays/MRI)": ("imaging", ("Findings", "Impression")),
    "Diagnostic Studies (NCS Studies)": ("ncs", ("Conclusion",)),
    "Laboratory Report": ("lab", ()),
    "Pathology Report": ("lab", ("Diagnosis",)),
    EVALUATION: ("evaluation", ("Subjective", "Assessment", "Impairment")),
    "Request for Authorization": ("clinical", ("Diagnosis",)),
    "Operative Report": ("operative", ()),
    "Letter": ("operative", ()),
    "Emergency Report": ("operative", ("Subjective", "Assessment")),
    "Cover Letters and Position Statements": ("cover_letter", ()),
    "Depositions": ("deposition", ()),
    "Depositions, Condensed": ("deposition", ()),
    "Performance and Disciplinary Records": ("hr_record", ()),
    "Claims": ("claims", ()),
    "Filings": ("claims", ()),
    "Encounter Records and Scheduling Documentation": ("clinical", ()),
    "Occupational Medicine Reports": ("clinical", ()),
    "Radiology Reports": ("imaging", ("Findings", "Impression")),
    "Legal Processing Forms": ("claims", ()),
}
DEFAULT_RUBRIC = ("clinical", ("Subjective", "Assessment"))
# Aliases in the order in which they are tried.
ALIASES = (
    ("QME", EVALUATION),
    ("AME", EVALUATION),
    ("Panel QME", EVALUATION),
    ("Supplemental", EVALUATION),
    ("Progress Notes", "Progress Notes and Reports by Treating Physicians"),
    ("Psych Reports", "Reports by Psychologists, Psychiatrists, Neuropsychologists"),
    ("Imaging", "Diagnostic Studies (X-rays/MRI)"),
    ("NCS", "Diagnostic Studies (NCS Studies)"),
    ("EMG", "Diagnostic Studies (NCS Studies)"),
    ("Lab", "Laboratory Report"),
    ("Pathology", "Pathology Report"),
    ("RFA", "Request for Authorization"),
    ("Cover Letter", "Cover Letters and Position Statements"),
    ("Deposition", "Depositions"),
    ("Encounter Records", "Encounter Records and Scheduling Documentation"),
    ("Occupational Medicine", "Occupational Medicine Reports"),
    ("Radiology", "Radiology Reports"),
    ("DOT", "Occupational Medicine Reports"),
)

# Report formats.
REPORT_COLUMNS = ("status", "your_date", "their_date", "your_pages", "their_match_pages", "match_confidence", "your_header", "their_header", "action")
QA_COLUMNS = ("provider", "pages", "category", "dos", "notes", "status", "minutes")
NOT_IN_DOCUMENT = {"yours": "NOT IN YOUR DOCUMENT", "theirs": "PAGE NOT FOUND IN THEIR PDF"}
NOT_IN_INDEX = {"yours": "NOT IN THEIR TOC", "theirs": "NOT IN YOUR TOC"}
NOT_IN_DOCUMENT_ACTION = {"yours": "Page not found in your PDF TOC", "theirs": "Page listed in their TOC but doesn't exist in their PDF file"}
REVIEW_ACTION = "MANUAL REVIEW NEEDED"
MISMATCH_ACTION = "VERIFY CORRECT DATE - Check header text for actual date"
EXTRACT_STEP = "Extract info"
