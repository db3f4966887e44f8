"""Results depend on these being exactly as they are.

Patterns are written so that Java and RE2 read them alike where RE2 can express them:
white space is spelled out (the class of ECMAScript), ends are absolute, classes of
letters are Unicode. WORD_START and WORD_END are ASCII word boundaries for Java.
"""

# Characters.
WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{WS}]"
NOT_S = f"[^{WS}]"
SUPERSCRIPTS = "¹²³⁴⁵⁶⁷⁸⁹⁰"
BULLETS = "•●◦▪▫‣⁃"
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"
ANY = r"[^\n\r\x{2028}\x{2029}]"

# Limits.
MAX_BYTES = 50 * 1024 * 1024
MAX_PDF_PAGES = 250
MAX_CHARACTERS = 1_000_000
PAGE_CHARACTERS = 5000
PAGE_FLOOR = 2500
PASSAGE_CHARACTERS = 240
SENTENCE_FLOOR = 50
LOOK_AHEAD_LINES = 5
SHORT_HEADING_WORDS = 7
CITATION_LOOK_BACK = 70
CODE_LOOK_BACK = 45
FOOTNOTE_LOOK_BACK = 50
SPARSE_CHARACTERS = 30
LOW_CONFIDENCE = 70
TASK_TIMEOUT_MS = 180_000
MAX_TITLE = 200
WORDS_PER_MINUTE = 160
PREVIEW_CHARACTERS = 70
RENDER_DPI, RENDER_POINTS, RENDER_PIXELS = 300, 72, 3600

# Lines of reference lists and the headings that end them.
REFERENCE_HEADING = rf"(?i)^(?:\d+[.)]?{S}+)?(?:references|bibliography|works cited|literature cited){S}*:?{S}*\z"
NEXT_SECTION = rf"(?i)^(?:(?:\d+[.)]?|[A-Z][.)]){S}+)?(?:appendix|appendices|appendix{S}+[A-Z0-9]|acknowledg(?:e)?ments?|supplement(?:ary)?(?:{S}+material)?|glossary|index|conclusions?|discussion|abstract|introduction|chapter{S}+\d+|section{S}+\d+)(?:{S}*[:.\-–]{S}*{ANY}*)?\z"
APPENDIX = r"(?i)^(?:appendix|appendices)(?:[^A-Za-z0-9_]|\z)"
SHORT_HEADING = r"^[\p{Lu}][\p{L}\p{M} &-]+\z"
ENTRY_MARK = rf"(?i)(?:(?:^|[^A-Za-z0-9_])(?:18|19|20)\d{{2}}[a-z]?(?:[^A-Za-z0-9_]|\z)|(?:^|[^A-Za-z0-9_])doi{S}*:|doi\.org)"
ENTRY_START = rf"^(?:(?:\[\d+\]|\d+[.)]){S}*)?(?:[\p{{Lu}}][\p{{L}}\p{{M}}'’.-]+,{S}*[\p{{Lu}}]|[\p{{Lu}}][\p{{L}}\p{{M}}'’.-]+{S}+[\p{{Lu}}](?:[.{WS},]|[A-Z](?:[^A-Za-z0-9_]|\z)|[^\P{{Lu}}A-Z][A-Za-z0-9_])|[\p{{Lu}}][\p{{L}}\p{{M}}'’.-]+{S}+et al\.|https?://|doi{S}*:)"

# What stands at the beginning of a line, or is a line.
EXPLICIT_LABEL = rf"^(?:¶{{1,2}}|§{{1,2}}|[Pp]aragraph){S}*\d{{1,4}}(?:{S}*[-–]{S}*\d{{1,4}})?[.):]?{S}*"
EXPLICIT_REST = r"^[“\"'‘\p{Lu}]"
NUMBERED_LABEL = rf"^(?:\[\d{{1,3}}\]|\(\d{{1,3}}\)|\d{{1,3}}[.)]){S}+"
BULLET = rf"^[{BULLETS}]+{S}*"
DASH = rf"^[-*+]{S}+"
DASH_REST = r"^[\p{L}“\"'‘]"
HEADING_OR_QUOTE = rf"^(?:#{{1,6}}|>){S}+"
MATH_REST = rf"^[\p{{L}}\p{{N}}_]+[{SUPERSCRIPTS}]*{S}*[=+−*/<>×÷-]"
RULER = rf"^(?:[-*_~─━—–]{S}*){{3,}}\z"
ORNAMENTS = rf"^[{BULLETS}†‡¶§]+\z"
NOTE_LABEL = rf"^[{SUPERSCRIPTS}†‡]+{S}+"
SOURCE_IDENTIFIER = rf"(?i)^(?:doi{S}*:{S}*10\.\d{{4,9}}/{NOT_S}+|https?://(?:dx\.)?doi\.org/{NOT_S}+)\.?\z"
PAGE_NUMBER = rf"(?i)^Page{S}+\d+(?:{S}+of{S}+\d+)?\z"

# Marks inside a page.
CITATION = rf"\[[1-9]\d{{0,2}}(?:{S}*[,;–—-]{S}*\d{{1,3}})*\]"
LAST_TOKEN = r"([\p{L}\p{N}_]+)\z"
STRUCTURE_BEFORE = rf"(?i)(?:^|[^A-Za-z0-9_])(?:arr|array|vector|matrix|interval|range|set|values?|index|coordinates?|chapter|section|paragraph|table|figure|equation|problem|example|step|case|item|experiment){S}*\z"
CODE_BEFORE = r"(?i)(?:^|[^A-Za-z0-9_])(?:code|array|vector|matrix|interval|range|set|values?|index|coordinates?)(?:[^A-Za-z0-9_.!?\n][^.!?\n]{0,44})?\z"
STATEMENT_AFTER = rf"^{S}*(?:=|[+*/]|(?:is|means|equals)(?:[^A-Za-z0-9_]|\z))"
OPEN_BEFORE = rf"\({S}*\z"
CLOSE_AFTER = rf"^{S}*\)"
PARENTHESES = r"\(([^()]{3,500})\)"
_SURNAME = rf"(?:(?:van|von|de|der|den|da|di|del|la){S}+)*[\p{{Lu}}][\p{{L}}\p{{M}}'’.-]+"
_AUTHORS = rf"{_SURNAME}(?:(?:{S}+(?:and|&){S}+|,{S}*){_SURNAME})*(?:{S}+et al\.?)?"
_YEAR = r"(?:18|19|20)\d{2}[a-z]?"
_WORK = rf"{_AUTHORS},?{S}+{_YEAR}(?:{S}*,{S}*{_YEAR})*(?:(?:,{S}*(?:p{{1,2}}\.|pages?)|:){S}*\d+(?:{S}*[-–]{S}*\d+)?)?"
AUTHOR_YEAR = rf"^(?:see{S}+|e\.g\.,?{S}*)?{_WORK}(?:{S}*;{S}*{_WORK})*\z"
NOTE_MARK = rf"[{SUPERSCRIPTS}†‡]+"
NOTE_TOKEN = r"([\p{L}\p{N}]+)[.!?,;:'’\"”)\]]*\z"
UNIT_OR_FUNCTION = r"(?i)^(?:mm|cm|km|mol|mmol|kwh|kcal|sin|cos|tan|cot|sec|csc|sinh|cosh|tanh|log|ln|exp)\z"
OPERATOR_AFTER = rf"^{S}*[+−\-*/=<>×÷]"
NOTE_AFTER = rf"^[{WS}.,;:!?)]"
EMPHASIS = rf"(?<![\p{{L}}\p{{N}}*_~])(\*{{1,2}}|_{{1,2}}|~~)(?={NOT_S})([^\n]*?{NOT_S})\1(?![\p{{L}}\p{{N}}*_~])"
BROKEN = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"

# Reasons of omissions, in the order in which their rules apply.
REFERENCE_LIST = "Reference list"
PARAGRAPH_LABEL = "Paragraph label"
DECORATIVE_SYMBOL = "Decorative symbol"
DECORATIVE_SEPARATOR = "Decorative separator"
FOOTNOTE_LABEL = "Footnote label"
SOURCE_ID = "Source identifier"
PAGE_NUMBER_REASON = "Page number"
CITATION_MARKER = "Citation marker"
AUTHOR_YEAR_CITATION = "Author and year citation"
FOOTNOTE_MARKER = "Footnote marker"
FORMATTING_MARKER = "Formatting marker"

# File routes.
TEXT_EXTENSIONS = ["txt", "md", "markdown", "csv", "log"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "bmp", "gif"]
IMAGE_TYPES = ["image/png", "image/jpeg", "image/webp", "image/bmp", "image/gif"]
OCR_LANGUAGES = [("eng", "English"), ("spa", "Spanish"), ("fra", "French"), ("deu", "German"), ("por", "Portuguese"), ("chi_sim", "Chinese (simplified)"), ("jpn", "Japanese")]

# Elements of a word-processing file that a reader of its raw text knows or
# passes over in silence, by local name.
WORD_ELEMENTS = {
    "p", "r", "t", "tab", "br", "noBreakHyphen", "softHyphen", "sym", "fldChar", "fldSimple", "instrText", "hyperlink", "tbl", "tr", "tc", "bookmarkStart", "bookmarkEnd",
    "footnoteReference", "endnoteReference", "commentReference", "footnoteRef", "endnoteRef", "annotationRef", "commentRangeStart", "commentRangeEnd",
    "AlternateContent", "Choice", "Fallback", "sdt", "sdtPr", "sdtEndPr", "sdtContent", "ins", "del", "object", "smartTag", "drawing", "pict", "inline", "anchor",
    "shape", "shapetype", "textbox", "txbxContent", "roundrect", "rect", "group", "imagedata", "lastRenderedPageBreak", "proofErr",
    "pPr", "rPr", "tblPr", "tblGrid", "trPr", "tcPr", "sectPr",
}
#: Of these, whose contents are not looked at.
WORD_CLOSED = {"pPr", "rPr", "tblPr", "tblGrid", "trPr", "tcPr", "sectPr", "sdtPr", "sdtEndPr", "del", "drawing", "pict", "object", "AlternateContent"}

# Messages.
TOO_LARGE = "This file is larger than 50 MB. Split or compress it before opening."
TOO_MANY_PAGES = "This PDF has more than 250 pages. Split it into smaller PDFs first."
TOO_MANY_CHARACTERS = "This document contains more than 1 million characters. Split it into smaller documents."
NO_TEXT = "No readable text was found. Try a clearer image, a different recognition language, or paste the text."
UNSUPPORTED = "This file type is not supported. Use PDF, DOCX, TXT, Markdown, PNG, JPG, WEBP, BMP, or GIF. Export older Word files as DOCX, or paste their text."
NOTE_NOT_DECODED = "PDF text could not be decoded. Used optical recognition."
NOTE_INVALID_MAP = "The PDF contains invalid character mappings. Used optical recognition."
NOTE_OPTICAL_FAILED = "Optical recognition failed. Kept the readable PDF text."
WARN_IMAGE = "Text was recognized from an image. Check names, numbers, and reading order."
WARN_LOW, WARN_LOW_PAGE, WARN_LOW_END = "Recognition confidence is low", " on page ", ". Review the text before listening."
WARN_BLANK = "No readable text was found on page %s."
WARN_OPTICAL = "Read %d of %d pages visually. Check names, numbers, and reading order. If characters are missing from the visible page, recognition cannot reliably restore them."
KIND_OPTICAL, KIND_AUTOMATIC, KIND_EMBEDDED = "PDF · optical OCR", "PDF · automatic OCR", "PDF · embedded text"
PASSWORD_EXCEPTION = "PasswordException"
PASSWORD_PROTECTED = "This PDF is password-protected. Save an unlocked copy, then open it here."
WARN_WORD = "Some Word content may not have been imported. Review the extracted text."
ERROR_NOT_ALLOWED = "Your browser blocked audio. Press Read aloud again, or open this page in Safari, Chrome, or Edge."
ERROR_VOICE = "This voice could not play. Choose another voice and press Read aloud."
ERROR_START = "Audio could not start. Try another voice or browser."
DEFAULT_TITLE = "Pasted text"
PREFERRED_VOICE = "Google UK English Male"
TIMED_OUT = "Text recognition took too long. Check your connection or try a smaller, clearer image."
