"""Column expressions over texts."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DATE_PATTERNS, DETERMINERS, KEYWORD_STOPWORDS, MIN_PHRASE_CHARS, OFF_TOPIC, PLATFORM_WORDS

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(c) -> Column:
    """Without control characters, each run of (Unicode) white space one blank, trimmed."""
    spaced = F.regexp_replace(F.regexp_replace(col(c), CONTROL, ""), r"(?U)\s+", " ")
    return F.trim(spaced)


def strip_white(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean_upload(c) -> Column:
    """Without control characters and outer white space; line feeds inside stay."""
    return strip_white(F.regexp_replace(col(c), CONTROL, ""))


def clean_review(c, emoji: bool = False) -> Column:
    """Links, mentions, hashes, markup, underscores and non-ASCII out; lower case. The order matters. With ``emoji``, pictographs
    are spelt out before non-ASCII goes."""
    steps = ((r"http\S+|www\S+", " "), (r"@\w+", " "), (r"#(\w+)", "$1"), (r"<.*?>", " "), ("_", " "), (r"[^\x00-\x7F]+", " "), (r"\s+", " "))
    first = reduce(lambda x, s: F.regexp_replace(x, *s), steps[:4], col(c))
    return F.lower(F.trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps[4:], emoji_words(first) if emoji else first)))


@cache
def _bare_letters() -> tuple[str, str]:
    """Letters with accents, and what each is without: of the blocks up to U+1FFF, where one letter is left."""
    pairs = [(chr(k), "".join(x for x in unicodedata.normalize("NFD", chr(k)) if not unicodedata.combining(x))) for k in range(0xC0, 0x2000)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(c) -> Column:
    """Letters without their accents, combining marks left out."""
    x = F.regexp_replace(F.translate(col(c), *_bare_letters()), r"[\x{300}-\x{36f}]+", "")
    return F.when(col(c).rlike(r"[^\x00-\x7F]"), x).otherwise(col(c))


@cache
def _emoji() -> dict[str, str]:
    """Pictographs and their names as words, by the Unicode names of the blocks that hold them."""
    blocks = ((0x2600, 0x27C0), (0x1F300, 0x1F650), (0x1F680, 0x1F700), (0x1F900, 0x1FB00))
    return {chr(k): f" {name.lower().replace('-', ' ')} " for a, b in blocks for k in range(a, b) if (name := unicodedata.name(chr(k), ""))}


def emoji_words(c) -> Column:
    """Each pictograph as the words of its name. Only texts with one are taken apart."""
    names = F.create_map(*[F.lit(x) for pair in _emoji().items() for x in pair])
    spelt = F.array_join(F.transform(F.split(col(c), ""), lambda ch: F.coalesce(F.try_element_at(names, ch), ch)), "")
    return F.when(col(c).rlike(r"[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"), spelt).otherwise(col(c))


def content_hash(c) -> Column:
    return F.sha2(normalise(c), 256)


def rating_label(c) -> Column:
    """Up to 2 negative, 3 neutral, the rest positive (2.5 too); null stays null."""
    r = col(c)
    return F.when(r <= 2, "negative").when(r == 3, "neutral").when(r.isNotNull(), "positive")


def label_rating(c) -> Column:
    return F.when(col(c) == "positive", 5.0).when(col(c) == "neutral", 3.0).when(col(c) == "negative", 1.0)


def _shape(pattern: str) -> str:
    """What every value begins with that a pattern of ``yyyy`` and two-letter fields can read."""
    return "^" + re.sub("[A-Za-z]+", lambda m: r"[+-]?\d{4,}" if m[0] == "yyyy" else r"\d\d", pattern)


def parse_time(c) -> Column:
    """ISO-8601, then the known patterns, day before month; null if none fits. A pattern is tried only on values of its shape,
    since a parse that fails costs many times one that doesn't."""
    v = col(c)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(v))
    return F.coalesce(iso, *(F.when(v.rlike(_shape(p)), F.try_to_timestamp(v, F.lit(p))) for p in DATE_PATTERNS))


def parse_rating(c) -> Column:
    """A number from 1 to 5, else null; NaN isn't a number here."""
    r = F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(r) & r.between(1, 5), r)


def month(c) -> Column:
    return F.date_format(F.try_to_date(col(c)), "yyyy-MM")


def phrase(c) -> Column:
    """A keyword: lower case, one leading determiner off, long enough, not a stop word, with a letter; else null."""
    bare = F.trim(F.regexp_replace(F.trim(F.lower(col(c))), f"^(?:{'|'.join(DETERMINERS)})\\s+", ""))
    good = (F.length(bare) >= MIN_PHRASE_CHARS) & ~bare.isin(list(KEYWORD_STOPWORDS)) & bare.rlike(r"\p{L}")
    return F.when(good, bare)


def words(c) -> Column:
    return F.regexp_count(col(c), F.lit(r"\S+"))


def word_root(c) -> Column:
    w = F.replace(F.lower(col(c)), F.lit(" "), F.lit(""))
    rule = F.when(F.lit(False), w)
    for suffix in ("ing", "tion", "ed", "er", "es", "s"):
        rule = rule.when(w.endswith(suffix) & (F.length(w) - len(suffix) >= 3), w.substr(F.lit(1), F.length(w) - len(suffix)))
    return rule.otherwise(w)


def capped(c, n: int) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("…"))).otherwise(col(c))


def in_scope(c) -> Column:
    return ~col(c).rlike(r"(?i)\b(?:" + "|".join(OFF_TOPIC) + r")\b")


def named_platform(c) -> Column:
    rule = F.when(F.lit(False), "")
    for word, platform in PLATFORM_WORDS:
        rule = rule.when(F.contains(F.lower(col(c)), F.lit(word)), platform)
    return rule


def evidence_line(platform, rating, label, id_, text) -> Column:
    """The tagged line that stands before an evidence text."""
    tag = F.format_string("[Source: %s | Rating: %s | Sentiment: %s | Id: %s]\n%s", F.coalesce(col(platform), F.lit("unknown")), F.coalesce(col(rating).cast("string"), F.lit("N/A")), F.coalesce(col(label), F.lit("unknown")), col(id_).cast("string"), col(text))
    return tag


def forced_binary(scores, fallback) -> Column:
    """negative if its score is the larger or equal, else positive; the label itself if a score is missing."""
    neg, pos = col(scores)["negative"], col(scores)["positive"]
    return F.when(neg.isNull() | pos.isNull(), col(fallback)).when(neg >= pos, "negative").otherwise("positive")


def banded(compound, band=0.05) -> Column:
    b = band if isinstance(band, Column) else F.lit(band)
    return F.when(col(compound) >= b, "positive").when(col(compound) <= -b, "negative").otherwise("neutral")


def best_label(scores) -> Column:
    """(label, confidence): the largest score, to four decimals; ties fall to the first label by name."""
    pairs = F.transform(F.map_entries(col(scores)), lambda e: F.struct((-e["value"]).alias("under"), e["key"].alias("label")))
    best = F.array_min(pairs)
    return F.struct(best["label"].alias("label"), F.round(-best["under"], 4).alias("confidence"))
