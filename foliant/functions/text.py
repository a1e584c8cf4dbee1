"""Text functions as column expressions; only Unicode normalisation needs an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITE = r"[\s\p{Z}]+"
WORD = r"[\p{L}\p{N}]+"

# Scripts, letters and function words that mark a language.
CJK = "[぀-ヿ㐀-䶿一-鿿가-힯]"
HAN = "[㐀-鿿]"
VIETNAMESE = "[ăâđêôơưàáạảãấầẩẫậắằẳẵặèéẹẻẽếềểễệìíịỉĩòóọỏõốồổỗộớờởỡợùúụủũứừửữựỳýỵỷỹ]"
ENGLISH_WORDS = ("the", "a", "an", "is", "was", "of", "in", "and", "to", "what", "who", "which", "when", "where", "how", "did", "does", "for", "by", "from")
ROMANCE_WORDS = ("el", "la", "los", "las", "del", "fue", "que", "una", "por", "con", "para", "est", "une", "les", "des", "pour", "qui")
# How an answer says that it has none, in three languages.
REFUSALS = (
    r"\b(not (mentioned|provided|stated|specified|included|available|supported|found|given|covered|contain)|no (information|mention|details?)|does(n't| not) (say|mention|state|specify|contain|provide|include|explain|indicate|describe)|cannot (find|determine|answer|be determined)|can't (find|determine|answer)|unable to|(do not|don't) know|not enough information|insufficient)\b",
    r"(không (được )?(đề cập|nêu|cung cấp|nhắc|chứa|có thông tin|có dữ liệu|tìm thấy|xác định|thể (xác định|trả lời|tìm))|chưa (được )?(đề cập|nêu)|không rõ|không biết|không đủ thông tin|thiếu thông tin)",
    r"(并未|並未|无法|無法|未(明确|具体)?(提供|提及|提到|说明|指出|涉及)|没有(直接|具体|明确)?(提及|提到|提供|说明|关于|相关|比较)|沒有(直接|具體|明確)?(提及|提到|提供|說明|關於|相關|比較))",
)
# Words that place a text in a domain.
DOMAINS = {
    "medical": ("medical", "healthcare", "clinical", "pharmaceutical", "biology"),
    "legal": ("legal", "law", "contract", "compliance", "regulatory"),
    "technical": ("technical", "engineering", "software", "it", "programming"),
    "academic": ("academic", "research", "scientific", "education"),
    "financial": ("financial", "finance", "accounting", "banking", "investment"),
}


def bounded(pattern: str) -> str:
    r"""The pattern with each \b between ASCII word characters and others, whatever Java's version takes for a word."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition; plain ASCII passes as it is."""
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def squeeze(x: Column) -> Column:
    """White space of any kind becomes single spaces; ends are trimmed."""
    return F.trim(F.regexp_replace(x, WHITE, " "))


def strip(x: Column) -> Column:
    """Trim white space of any kind."""
    return F.regexp_replace(x, rf"^{WHITE}|{WHITE}$", "")


def normalize_text(x: Column, compose: bool = True) -> Column:
    return squeeze(F.lower(nfc(x) if compose else x))


def tokenize(x: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), 0)


def quoted(needle: str) -> str:
    return r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"


def contains_phrase(text: Column, needle: Column) -> Column:
    """The normalised needle stands in the text as whole words."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tokenize(c), " "), F.lit(" "))
    return (F.size(tokenize(needle)) > 0) & F.contains(padded(text), padded(needle))


def clean_name(x: Column, size: int = 200) -> Column:
    return F.left(squeeze(x), F.lit(size))


def fold_text(x: Column) -> Column:
    """Lower case; dashes and quotes in one form each, one character for one."""
    return F.translate(F.lower(x), "‐‑‒–—―‘’‚“”„«»", "------'''\"\"\"\"\"")


def jaccard_words(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of white-space words; 0 if both are empty."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), WHITE), lambda w: w != ""))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def session_title(x: Column) -> Column:
    return F.when(F.length(x) > 60, F.concat(F.rtrim(F.left(x, F.lit(60))), F.lit("…"))).otherwise(x)


def cited_indices(x: Column, passages: Column) -> Column:
    """Numbers in [n], [n, m] or [n; m] from 1 to the number of passages, distinct, ascending."""
    groups = F.regexp_extract_all(x, F.lit(r"\[(\d{1,6}(?:\s*[,;]\s*\d{1,6})*)\]"), 1)
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*[,;]\s*"), lambda n: n.cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= passages))))


def normalize_citations(x: Column) -> Column:
    return F.regexp_replace(x, r"【(\d+)[^】]*】", r"[$1]")


def detect_cjk(x: Column) -> Column:
    return x.rlike(CJK)


def detect_vietnamese(x: Column) -> Column:
    return F.lower(x).rlike(VIETNAMESE)


def count_words(x: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.regexp_extract_all(F.lower(x), F.lit(bounded(rf"\b({'|'.join(words)})\b")), 0))


def is_english(x: Column) -> Column:
    return (count_words(x, ENGLISH_WORDS) > 0) & ~detect_vietnamese(x)


def question_language(x: Column) -> Column:
    return F.when(detect_vietnamese(x), "Vietnamese").when(is_english(x), "English").otherwise("the language of the question")


def is_language_slip(question: Column, answer: Column, complete: bool = True) -> Column:
    """The answer is in a script or language that the question isn't in; only a complete one is judged by its words."""
    script = ~detect_cjk(question) & detect_cjk(answer)
    if not complete:
        return script
    romance = is_english(question) & ~is_english(answer) & (count_words(answer, ROMANCE_WORDS) >= 2)
    return script | F.when(detect_vietnamese(question), ~detect_vietnamese(answer)).otherwise(romance)


def wrong_language(x: Column) -> Column:
    return x.rlike(HAN)


def normalize_answer(x: Column) -> Column:
    """Lower case without citations, punctuation and English articles."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), r"\[\d+(?:\s*[,;]\s*\d+)*\]", " "), r"[\p{P}\p{S}]", " ")
    return F.array_join(F.filter(F.split(squeeze(plain), " "), lambda w: ~w.isin("a", "an", "the")), " ")


def contains_answer(answer: Column, golds: Column) -> Column:
    """Any gold answer stands in the answer as whole words, both normalised."""
    padded = F.concat(F.lit(" "), normalize_answer(answer), F.lit(" "))
    return F.exists(golds, lambda g: (normalize_answer(g) != "") & F.contains(padded, F.concat(F.lit(" "), normalize_answer(g), F.lit(" "))))


def abstained(x: Column) -> Column:
    return F.lower(x).rlike(bounded("|".join(REFUSALS)))


def parse_json_object(x: Column) -> Column:
    """From the first { to the last }, as VARIANT; null if it is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit("")))


def parse_triplets(x: Column) -> Column:
    """Items of a JSON array that have subject, relation and object; confidence 0.8 unless given."""
    items = F.from_json(F.regexp_extract(x, r"(?s)(\[.*\])", 1), "array<struct<subject:string,relation:string,object:string,confidence:double>>")
    whole = F.filter(items, lambda t: t["subject"].isNotNull() & t["relation"].isNotNull() & t["object"].isNotNull())
    return F.transform(whole, lambda t: F.struct(strip(t["subject"]).alias("subject"), strip(t["relation"]).alias("relation"), strip(t["object"]).alias("object"), F.coalesce(t["confidence"], F.lit(0.8)).alias("confidence")))


def parse_fenced_json(x: Column) -> Column:
    inner = F.regexp_extract(x, r"(?s)```json\s*(.*?)```", 1)
    return F.try_parse_json(F.when(inner != "", inner).otherwise(x))


def key_points(x: Column, most: int = 10) -> Column:
    """Bullet lines without their bullets, the first ten."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda line: line.rlike(r"^[-*•]"))
    return F.slice(F.transform(lines, lambda line: strip(F.regexp_replace(line, r"^[-*•]+", ""))), 1, most)


def strip_qualifier(x: Column) -> Column:
    return F.regexp_replace(x, r"\s*\([^()]*\)\s*$", "")


def same_entity(a: Column, b: Column) -> Column:
    """Names are equal or one holds the other as whole words, with or without a trailing qualifier, from 3 letters on."""
    forms = lambda x: F.array(squeeze(F.lower(x)), squeeze(F.lower(strip_qualifier(x))))
    inside = lambda p, q: F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" ")))
    return F.exists(forms(a), lambda p: F.exists(forms(b), lambda q: (F.length(p) >= 3) & (F.length(q) >= 3) & (inside(p, q) | inside(q, p))))


def nearest_occurrence(text: Column, needle: Column, near: Column) -> Column:
    """The 0-based occurrence nearest to a place (the first of two equally near ones); null if there is none.

    The text is cut before each occurrence, and one pass over the pieces keeps the best place so far.
    """
    pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), needle, F.lit(r"\E)")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, piece: Column) -> Column:
        nearer = F.startswith(piece, needle) & (state["best"].isNull() | (F.abs(state["at"] - near) < F.abs(state["best"] - near)))
        return F.struct((state["at"] + F.length(piece)).alias("at"), F.when(nearer, state["at"]).otherwise(state["best"]).alias("best"))

    return F.aggregate(pieces, start, step, lambda state: state["best"])


def safe_top_k(k: Column) -> Column:
    return F.least(F.lit(20), F.greatest(F.lit(1), F.coalesce(k, F.lit(5))))


def detect_domain(x: Column) -> Column:
    """The domain with most of its words in the text (the first of equals); 'general' without any."""
    lower = F.lower(x)
    scores = [sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0)) for words in DOMAINS.values()]
    best = F.greatest(*scores)
    return F.when(best == 0, "general").otherwise(F.coalesce(*(F.when(s == best, d) for d, s in zip(DOMAINS, scores, strict=True))))


def route_domain(x: Column) -> Column:
    """A domain's own name first, then its words, else 'general'."""
    lower = F.lower(strip(x))
    exact = F.coalesce(*(F.when(lower == d, d) for d in DOMAINS))
    held = F.coalesce(*(F.when(lower.rlike("|".join(words)), d) for d, words in DOMAINS.items()))
    return F.coalesce(exact, held, F.lit("general"))
