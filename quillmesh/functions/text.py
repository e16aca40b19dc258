"""Text normalising, matching and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question words that are not searched for; how names of manuals tell number and type.
STOP_WORDS = (
    "a an the of in on at to for from by with and or is are was were be been what which who whom how when where why does do did "
    "can could should would will may this that these those it its as into than then there their they you your we our i"
).split()
DOCUMENT_NUMBER = r"2NGA\d{6}|(?<!\d)\d{6}(?!\d)"
SECTION_NUMBER = r"^([A-Z]\.)?[\d.]*\d\.?\s+"

# Letters that readers of pictures confuse, and the scores of labels.
CONFUSED = ("OILSZB", "011528")
LEAST_SCORE, LEAST_MARGIN, CONTAINED, LEAST_CONTAINED = 0.65, 0.05, 0.95, 3


def norm(text: Column) -> Column:
    """Upper case, letters and digits alone."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")


def fold_confusions(text: Column) -> Column:
    """What character recognition takes for each other becomes one digit."""
    return F.translate(text, *CONFUSED)


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores, in lower case; order and repeats stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))


def question_terms(text: Column, drop: Column | None = None) -> Column:
    """Tokens of a question without stop words and without the words in `drop`."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    out = F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))
    return out if drop is None else F.filter(out, lambda w: ~F.array_contains(drop, w))


def collapse(text: Column) -> Column:
    """White space, no-break spaces included, becomes single spaces; trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s ]+", " ")))


def margin_key(text: Column) -> Column:
    return F.regexp_replace(collapse(text), "[0-9]+", "#")


def strip_number(text: Column) -> Column:
    """Without a leading section number such as 3.1.2 or A.4."""
    return F.regexp_replace(F.trim(text), SECTION_NUMBER, "")


def document_number(stem: Column) -> Column:
    """The first number in a file's name that has the form of a document's; null if there is none."""
    return F.nullif(F.regexp_extract(stem, DOCUMENT_NUMBER, 0), F.lit(""))


def document_type(stem: Column) -> Column:
    low = F.lower(stem)
    return F.when(low.rlike("(^|[_ -])tm([_ -]|$)"), "technical manual").when(low.contains("instruction manual"), "instruction manual").when(low.startswith("ma_"), "manual")


def safe_name(text: Column) -> Column:
    return F.translate(text, ' /\\:*?"<>|', "__________")


def scan_index(image_name: Column, faces: int = 6) -> Column:
    """Six faces of a cube share a scan; counted from 1. Null without a number."""
    return F.floor(F.nullif(F.regexp_extract(image_name, r"img_([0-9]+)", 1), F.lit("")).cast("int") / faces).cast("int") + 1


def description(*lines: Column) -> Column:
    """The lines that are not null."""
    return F.concat_ws("\n", *lines)


def folded(text: str) -> str:
    """Letters and digits in capitals, those that look alike made one."""
    return "".join(ch for ch in text.upper() if ch.isalnum()).translate(str.maketrans(*CONFUSED))
