"""Text functions as Column expressions: tokens, hygiene tests, normalisers, id parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, inflectional suffixes, stop words, caption words, incomplete phrases.
TOKEN = "[0-9A-Za-zА-Яа-яЁё_]+"
SUFFIXES = [
    "иями", "ями", "ами", "ого", "его", "ому", "ему", "ыми", "ими", "иях", "ях", "ах", "ией", "ей", "ой", "иям", "ям", "ам",
    "ию", "ью", "ия", "ья", "ов", "ев", "ом", "ем", "ы", "и", "а", "я", "у", "ю", "е", "о",
]
STOP_WORDS = [
    "и", "в", "во", "на", "к", "ко", "по", "из", "у", "о", "об", "от", "до", "для", "при", "без", "с", "со", "за", "над", "под", "про", "через",
    "это", "этот", "эта", "эти", "того", "тому", "тем", "таким", "такая", "как", "так", "же", "ли", "бы", "не", "ни", "нет", "есть", "будет",
    "или", "либо", "а", "но", "да", "то", "т", "д", "тд", "тп", "что", "чтобы", "который", "которая", "которые", "когда", "где", "куда",
    "какой", "какая", "какие", "каких", "какому", "нужно", "можно", "нельзя", "все", "всё", "их", "его", "ее", "её", "мы", "вы", "они", "она", "он",
    "я", "ты", "мне", "нам", "вам", "здесь", "там", "тут", "после", "перед", "между", "если", "чем",
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "is", "are", "be", "as", "by", "at", "from",
]
CAPTION_WORDS = ["рисунок", "таблица", "figure", "table", "диаграмма", "схема", "листинг"]
INCOMPLETE = [r"\(см\.\s*$", r"см\.\s*рисунок\s*\d+\)\s*:$", r"см\.\s*подробнее.*$", r"в\s+разделе\s*$", r"в\s+разделе\s*\(?$"]
TOKEN_OR_SIGN = r"(?U)\w+|[^\w\s]"
PLACEHOLDER = r"(?i)\b(?:BIBREF|FIGREF|TABREF)\d+\b"
LETTERS_DIGITS = "[a-z0-9а-яё]+"


def stem_pattern() -> str:
    """A word of four letters or more before the longest suffix."""
    return "^(.{4,}?)(?:" + "|".join(sorted(SUFFIXES, key=len, reverse=True)) + ")$"


def strip(c: Column) -> Column:
    """Without white space at both ends; null is empty. Only texts with some at an end are searched."""
    t = F.coalesce(c, F.lit(""))
    ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(r"(?U)\s")
    return F.when(ends, F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t)


def stem(token: Column) -> Column:
    cyrillic = token.rlike("[а-яА-ЯёЁ]")
    return F.when((F.length(token) >= 5) & cyrillic, F.regexp_replace(token, stem_pattern(), "$1")).otherwise(token)


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, stemmed; a text without a Cyrillic letter has nothing to stem."""
    t = F.lower(F.coalesce(c, F.lit("")))
    found = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    return F.when(t.rlike("[а-яА-ЯёЁ]"), F.transform(found, stem)).otherwise(found)


def query_terms(c: Column) -> Column:
    """Distinct tokens of a query over one character that are no stop words, in order; stop words are tested after stemming."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(tokenize(c), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def dedupe_key(c: Column) -> Column:
    collapsed = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    return F.regexp_replace(collapsed, r"^[ \t\n\r.,;:!—-]+|[ \t\n\r.,;:!—-]+$", "")


def is_caption(c: Column) -> Column:
    return strip(F.lower(F.coalesce(c, F.lit("")))).rlike("^(" + "|".join(CAPTION_WORDS) + ")")


def is_bullet_list(c: Column) -> Column:
    t = strip(c)
    markers = F.length(t) - F.length(F.translate(t, "•—-*·", ""))
    lines = F.length(t) - F.length(F.translate(t, "\n", ""))
    return (markers >= 3) | (t.startswith("•") & (lines >= 1)) | ((lines >= 2) & (markers >= 1))


def is_table_header(c: Column) -> Column:
    t = strip(c)
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    upper = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return ~t.rlike("[.!?;]") & (F.size(words) >= 5) & ((upper * 2 >= F.size(words)) | (F.size(words) >= 10))


def is_heading(c: Column) -> Column:
    t = strip(c)
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"(?U)[^\p{L}\s]", ""))
    return (n > 0) & (n <= 80) & ~t.rlike("[.!?]") & (letters * 10 >= n * 9) & t.rlike(r"^\p{Lu}")


def is_incomplete(c: Column) -> Column:
    t = strip(F.lower(F.coalesce(c, F.lit(""))))
    return t.rlike("(?:" + "|".join(INCOMPLETE) + ")") & (t != "")


def alpha_ratio(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.when(strip(t) == "", 0.0).otherwise(F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.length(t))


#: Texts that are noise by themselves.
PUNCTUATION_ONLY = [".", ",", ";", ":", "-", "—", "–", "(", ")", "[", "]", "{", "}", "},", "{,"]


def is_noise(c: Column) -> Column:
    s = strip(c)
    sign = (F.length(s) <= 2) & s.rlike(r"(?U)^[^\w\s]$")
    return c.isNull() | (s == "") | s.isin(PUNCTUATION_ONLY) | s.rlike(r"^\p{Nd}{1,3}$") | sign | ((F.length(s) < 10) & (alpha_ratio(s) < 0.2))


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(r"^\p{Nd}{1,3}$")


def normalize_ws(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n[ \t]+", "\n"))


def strip_page_number(c: Column) -> Column:
    """Up to three digits before a word that begins with a letter."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s*\d{1,3}\s+(?=\p{L})", "")


def normalize_evidence(c: Column) -> Column:
    """Lower case without citation placeholders, white space collapsed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)" + PLACEHOLDER, " ")
    return strip(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def normalize_snippet(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_snippet(c), " "), lambda w: w != ""))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of b's distinct tokens that a has; 0 without tokens."""
    return set_ratio(token_set(a), token_set(b))


def set_ratio(x: Column, y: Column) -> Column:
    """``overlap_ratio`` of texts whose ``token_set`` is known."""
    return F.when(F.size(y) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(y))


def count_tokens(c: Column) -> Column:
    """Words and signs: the counter that needs no vocabulary."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN_OR_SIGN), F.lit(0)))


def count_runs(c: Column) -> Column:
    """Runs of letters and digits of a text in lower case."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LETTERS_DIGITS), F.lit(0)))


def chunk_windows(c: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Overlapping pieces of a text, its white space collapsed first.

    A piece begins every ``size - overlap`` characters until one reaches the end; it has ``size`` characters, or goes to the last space
    in them if a third of the size (100 at least) is before that.
    """
    t = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    stride = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / stride)).cast("int")

    def piece(k: Column) -> Column:
        whole = F.substring(t, k * stride + 1, F.lit(size))
        spaced = F.length(F.regexp_replace(whole, " [^ ]*$", ""))
        short = (k < last) & (spaced < F.length(whole)) & (spaced > max(100, size // 3))
        return strip(F.when(short, F.left(whole, spaced)).otherwise(whole))

    return F.filter(F.transform(F.sequence(F.lit(0), last), piece), lambda p: p != "")


def section_key(c: Column) -> Column:
    """Section of a chunk id: ``D_abstract`` is in ``D.abstract``, ``D.1.2`` in ``D.1``; others stand for themselves."""
    return F.when(c.endswith("_abstract"), F.regexp_replace(c, "_abstract$", ".abstract")).otherwise(F.regexp_replace(c, r"^(.*)\.(\d+)\.(\d+)$", "$1.$2"))


def doc_key(c: Column) -> Column:
    """Document of a chunk id."""
    return F.when(c.endswith("_abstract"), F.regexp_replace(c, "_abstract$", "")).otherwise(F.regexp_replace(c, r"^(.*)\.(\d+)\.(\d+)$", "$1"))


def doc_of_chunk(c: Column) -> Column:
    """The document that a chunk's id names: without ``_abstract``, or without its last two parts, or the last of two."""
    parts = F.split(strip(c), r"\.")
    n = F.size(parts)
    shorter = F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.when(n >= 3, n - 2).otherwise(n - 1))), ".")
    return F.when(strip(c).endswith("_abstract"), F.regexp_replace(strip(c), "_abstract$", "")).otherwise(shorter)


def doc_of_section(c: Column) -> Column:
    """The document that a section's id names: without ``.abstract`` or a number at the end."""
    t = strip(c)
    return F.when(t.endswith(".abstract"), F.regexp_replace(t, r"\.abstract$", "")).otherwise(F.regexp_replace(t, r"(?U)\.\d+$", ""))


def comparison_parts(c: Column) -> Column:
    """struct<first, second> of ``first_vs_second``; null without the mark."""
    parts = F.split(c, "_vs_", 2)
    return F.when(F.contains(c, F.lit("_vs_")), F.struct(parts[0].alias("first"), parts[1].alias("second")))


def section_order(c: Column) -> Column:
    """The number after ``ch`` in a section's id; sections without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^.*?ch(\d+)(?:ch.*)?$", 1), F.lit("")).cast("int"), F.lit(999_999))


def qid_order(c: Column) -> Column:
    """struct<number, id>: ``Q12`` and ``Qx12`` by their number, other ids by the last number in them, those without one last."""
    numbers = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    return F.struct(F.coalesce(F.when(F.size(numbers) > 0, F.element_at(numbers, -1).cast("long")), F.lit(10**9)).alias("number"), c.alias("id"))


def safe_int(c: Column) -> Column:
    """The whole number that a string is; null for anything else."""
    return F.when(strip(c.cast("string")).rlike(r"^[+-]?\d+$"), strip(c.cast("string"))).try_cast("long")


def safe_double(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit("")).try_cast("double")


def pmid_from_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)(?:[/?#].*)?$", 1), F.lit(""))


def normalize_pmcid(c: Column) -> Column:
    t = strip(F.regexp_replace(F.upper(strip(c)), "^PMC", ""))
    return F.when(t != "", F.concat(F.lit("PMC"), t))


def chunk_order(c: Column) -> Column:
    """All integers of an id, which sort before ids without any."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("decimal(38,0)"))
    return F.struct((F.size(numbers) == 0).alias("none"), numbers.alias("numbers"), c.alias("id"))


def run_name(c: Column) -> Column:
    """A name that can be a folder's."""
    t = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.,-]", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(t == "", "run").otherwise(t)


def role_prefix(model: str, role: str) -> str:
    """What an encoder wants before a text of this role (query or passage)."""
    name = model.lower()
    if "e5" in name:
        return "query: " if role == "query" else "passage: "
    if "bge" in name and "en" in name and role == "query":
        return "Represent this sentence for searching relevant passages: "
    return ""


def seed(c: Column) -> Column:
    """The first 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")


def invert_label(c: Column) -> Column:
    return F.when(c == "A", "B").when(c == "B", "A").otherwise(c)


def normalize_label(label: Column, perm: Column) -> Column:
    """A judge's A, B or equal, seen in order AB or BA, as first, second or equal; other values are null."""
    first = ((perm == "AB") & (label == "A")) | ((perm == "BA") & (label == "B"))
    second = ((perm == "AB") & (label == "B")) | ((perm == "BA") & (label == "A"))
    return F.when(label == "equal", "equal").when(first, "first").when(second, "second")
