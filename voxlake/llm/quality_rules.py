"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much goes too.

A line is what stands between two \\n. Blank lines (no word) are neither judged nor counted. A line fails when

* punctuation: its symbols are more than 1/12 of its word bytes, or it has under ``short_line`` words and no closing mark;
* navigation: it holds three or more separators of a menu (bars, arrows, middle dots), at least one for every four words; or
  at least half of its words are links; or it begins with a bullet and has under ``short_item`` words and no closing mark;
* boilerplate: it holds one of PHRASES in any case, in the corpus' languages, or equals an earlier line of the text.

A text that the base rules pass is rejected when the failing lines hold more than ``max_lost_percent`` of its words, when
more than ``max_bullet_percent`` of its lines begin with a bullet, or more than ``max_ellipsis_percent`` end in an ellipsis
(both shares as in published rules for web corpora: 90 and 30). Phrases are notices that name no subject of a text: rights,
terms, cookies, scripts, sign-ups and sharing.

Results for odd rows: a null or empty text has no words, fails the base rules and isn't kept. Repeated rows and repeated
ids each get their own row. Columns other than ``doc_id`` and ``text`` are not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_BYTES, in_arrow, slices, table

SYMBOLS = b"#*$%&|<>"
LINE_SYMBOLS = SYMBOLS + b"!"
CLOSING = (".", "!", "?", ":", ";", ")", '"', "'", "…", "”", "’", "»", "。")
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript", "click here", "read more", "sign up",
    "subscribe to our", "licensed under", "released under the", "lorem ipsum", "share this article", "log in to comment", "skip to content",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "mehr lesen", "javascript aktivieren", "newsletter abonnieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "cliquez ici", "lire la suite", "activer javascript", "abonnez-vous à",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "haga clic aquí", "leer más", "activar javascript", "suscríbete a",
)
SEPARATORS = ("|", "»", "›", "•", "·")
BULLETS = ("-", "*", "•", "–", "·", "‣")
LINKS = ("http://", "https://", "www.")
ELLIPSES = ("...", "…")
WINDOW = 8


@dataclass(frozen=True)
class LineRules:
    short_line: int = 4
    short_item: int = 6
    min_words: int = 20
    max_repeat_percent: int = 30
    max_lost_percent: int = 50
    max_bullet_percent: int = 90
    max_ellipsis_percent: int = 30


_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_failed_lines long, n_lost_words long, n_lines long, n_bullet_lines long, n_ellipsis_lines long, base_failed boolean, kept boolean, cleaned_text string"
)
_CLOSING = tuple(c.encode() for c in CLOSING)
_SEPARATORS, _BULLETS, _LINKS, _ELLIPSES = (tuple(x.encode() for x in xs) for xs in (SEPARATORS, BULLETS, LINKS, ELLIPSES))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    win = h[:n].copy()
    for k in range(1, window):
        win *= _ODD
        win ^= win >> np.uint64(29)
        win += h[k : n + k]
    ordered = np.sort(win)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(win, twice))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _clean(text: str | None, rules: LineRules) -> tuple:
    raw = (text or "").encode("utf-8", "replace")
    low = (text or "").lower()
    phrases = [p for p in PHRASES if p in low]
    marks = [m for m in _SEPARATORS if m in raw]
    linked = any(x in raw for x in _LINKS)
    words, kept, seen = [], [], set()
    dup = failed = lost = lines = bullets = dots = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            kept.append(line)
            continue
        words += own
        lines += 1
        again = line in seen
        seen.add(line)
        dup += again
        size = sum(map(len, own))
        bars = sum(map(line.count, marks))
        item = own[0] in _BULLETS
        bullets += item
        dots += own[-1].endswith(_ELLIPSES)
        bad = (
            again
            or (size - len(b"".join(own).translate(None, LINE_SYMBOLS))) * 12 > size
            or (len(own) < (rules.short_item if item else rules.short_line) and not own[-1].endswith(_CLOSING))
            or (bars >= 3 and bars * 4 >= len(own))
            or (linked and 2 * sum(w.startswith(_LINKS) for w in own) >= len(own))
            or (phrases and any(p in line.decode("utf-8", "replace").lower() for p in phrases))
        )
        if bad:
            failed += 1
            lost += len(own)
        else:
            kept.append(line)
    n, repeats = len(words), repeated_words(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, WS_BYTES)))
    base = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    ok = not base and 100 * lost <= rules.max_lost_percent * n and 100 * bullets <= rules.max_bullet_percent * lines and 100 * dots <= rules.max_ellipsis_percent * lines
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return n, chars, symbols, dup, repeats, failed, lost, lines, bullets, dots, base, ok, b"\n".join(kept).decode("utf-8", "replace")


def line_first_clean(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: the counts, the verdict and (``with_text``) what is left of the text.

    One pass over the texts without a shuffle; a worker holds a slice of 256 texts."""
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    schema = _SCHEMA if with_text else _SCHEMA.rpartition(",")[0]

    def run(batches):
        for b in slices(batches):
            rows = list(zip(*(_clean(t.as_py(), rules) for t in b.column(1)), strict=True))
            cols = [b.column(0), *map(pa.array, rows)]
            yield pa.RecordBatch.from_arrays(cols[: len(names) - (not with_text)], names=names[: len(names) - (not with_text)])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first_clean(table(spark, sf_dir, "documents"), with_text=False)


_W = "[^\\x20\\x09-\\x0D]+"
_QUOTED = "|".join(PHRASES).replace("'", "''")
_ITEM = "^[\\x20\\x09-\\x0D]*(?:[*•–·‣-])(?:[\\x20\\x09-\\x0D]|$)"
_LINK = "^(?:https?://|www[.])"
_END = "(?:[.!?:;)\"''…”’»。])[\\x20\\x09-\\x0D]*$"
ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '{_W}')) AS lw,
    strlen(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS size,
    strlen(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) AS sym,
    length(regexp_replace(line, '[^|»›•·]', '', 'g')) AS bars, regexp_matches(line, '{_ITEM}') AS item,
    len(list_filter(regexp_extract_all(line, '{_W}'), lambda w: regexp_matches(w, '{_LINK}'))) AS links,
    regexp_matches(line, '(?:[.][.][.]|…)[\\x20\\x09-\\x0D]*$') AS dots,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), f AS (
  SELECT *, again OR sym * 12 > size OR (lw < CASE WHEN item THEN 6 ELSE 4 END AND NOT regexp_matches(line, '{_END}')) OR (bars >= 3 AND bars * 4 >= lw)
    OR 2 * links >= lw OR regexp_matches(lower(line), '({_QUOTED})') AS bad
  FROM l WHERE lw > 0
), ln AS (
  SELECT doc_id, sum(lw) AS nw, count(*) FILTER (again) AS dup, count(*) FILTER (bad) AS failed, coalesce(sum(lw) FILTER (bad), 0) AS lost,
    count(*) AS lines, count(*) FILTER (item) AS bullets, count(*) FILTER (dots) AS ellipses FROM f GROUP BY doc_id
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, ws FROM (SELECT doc_id, regexp_extract_all(text, '{_W}') AS ws FROM documents)
), g AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 7], ' ') AS win FROM w WHERE pos + 7 <= len(ws)
), r AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1
), c AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM r) GROUP BY doc_id
), a AS (
  SELECT d.doc_id, CAST(coalesce(nw, 0) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words,
    CAST(coalesce(lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(bullets, 0) AS BIGINT) AS n_bullet_lines, CAST(coalesce(ellipses, 0) AS BIGINT) AS n_ellipsis_lines
  FROM documents d LEFT JOIN ln USING (doc_id) LEFT JOIN c USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= 50 * n_words
    AND 100 * n_bullet_lines <= 90 * n_lines AND 100 * n_ellipsis_lines <= 30 * n_lines AS kept
FROM a
"""
