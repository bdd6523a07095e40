"""Surrogates for personal data: keyed, of the same type, gender, script and format, distinct and consistent.

Entities are e-mail addresses, phone numbers, card numbers (13 to 19 digits), social security numbers, IBANs, IPv4
addresses, hexadecimal secrets and access keys, and person names (after a title, after a word such as "Contact:" or "Dear"
before two capitalised words, or a known given name before a capitalised word; a third word of a name is taken where one of
the first two is a known given name). A found name part stands for the person wherever it is a whole, capitalised word of
the same text (a common word only before other words than it is a common word before, or inside a sentence).

Each distinct entity, in its canonical form (lower case, no separators, ASCII digits, a phone number's last ten digits, name
part by name part), gets one surrogate in the whole corpus, so mentions of one entity stay mentions of one; a mention then
takes its own format back (separators, case, country code, digits of its script). A name part's gender is that of most of
its mentions in the corpus that tell one. Candidates come from a keyed hash; a candidate that another entity has, or that is
itself an entity of the corpus, is drawn again, in joins over the distinct entities, until all differ. From the sixth
attempt on candidates grow longer than the entity, so that no set of entities uses them up.

The key is an argument; the query and the pipeline take it from the setting spark.voxlake.pii.key and, where that is unset,
draw one for the session, so that no key stands in the code: set it to have the same surrogates in another session.

Results for odd rows: a null text stays null, an empty one empty; repeated rows get the same text each; rows with one
doc_id are separate texts; a text without entities passes unchanged; an empty table gives no row. ``surrogated`` keeps the
other columns as they are. Texts are scanned whole. Only the texts that can hold an entity are shuffled.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, shared_dir, slices, stored, table

TITLES = {
    "m": "Mr Mister Monsieur Herr Herrn Señor Signor Sir г-н господин κύριος".split(),
    "f": "Mrs Ms Miss Mme Madame Mademoiselle Frau Señora Señorita Sra Signora Lady г-жа госпожа κυρία".split(),
    "n": "Dr Prof Professor Doctor Doktor Docteur".split(),
}
#: Common given names of the corpus' languages and of others; a sample of them, names that aren't listed need a title or a cue.
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Peter "
        "Pierre Jean Jacques Michel Philippe Alain Nicolas Laurent Julien Hans Klaus Jürgen Wolfgang Stefan Dieter Günter Carlos José Juan Miguel Luis Javier Pedro Diego "
        "Giovanni Marco Luca Ahmed Mohammed Omar Ali Hassan Wei Jian Hiroshi Kenji Raj Amit Rahul Arjun Sanjay Иван Дмитрий Сергей Алексей Николай Андрей Γιώργος Νίκος Κώστας Δημήτρης"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Emma Alice Olivia Sophia "
        "Marie Sophie Camille Claire Nathalie Isabelle Chloé Anna Ursula Ingrid Heike Petra Sabine Monika Greta Carmen María Lucía Isabel Ana Sofía Elena Giulia Chiara "
        "Fatima Aisha Leila Mei Xia Yuki Sakura Priya Anjali Deepa Kavita Анна Елена Ольга Мария Наталья Татьяна Μαρία Ελένη Κατερίνα Σοφία"
    ).split(),
}
#: Words after which two or three capitalised words are a name.
CUES = "Contact Attn Dear Signed Sincerely Regards Author Patient Customer Employee Applicant Kontakt Autor Auteur Paciente Cliente Employé".split() + [
    "[Nn]ame(?: is)?", "[Nn]amed", "Nom", "Nombre", "Verfasser", "I['’]m", "I am", "Ask", "Meet", "Thanks", "Ich bin", "Ich heiße", "Je suis", "Je m['’]appelle", "Soy", "Me llamo",
]
#: Words that begin a sentence behind a name and are never a further part of it; particles of names (de, la, von) aren't here.
FUNCTION = frozenset("the a an and or but if in on at to he she it we they this that these those is was der die das und ein eine er sie les un une et il elle y".split())
#: Syllables and endings that surrogate names are made of, by script.
STEMS = {
    "latin": "al ber cor dan el fen gar hol is jor kel lam mar nor or pel quin ros sal tor ul ven wil yor zan".split(),
    "cyrillic": "ал бор вик гор дан ев жар зор ил кар лад мир нов ор пав род сав тим ур фед".split(),
    "greek": "αλ βασ γερ δημ ελ ζαν ηλ θεμ ιασ καλ λεω μαρ νικ ορ παν ροδ σωτ τιμ φιλ χαρ".split(),
    "han": "安 博 春 德 恩 芳 国 海 嘉 建 君 康 兰 明 宁 鹏 青 荣 思 文 晓 雅 永 泽".split(),
}
ENDS = {
    "latin": {"m": ["on", "ard", "in"], "f": ["a", "ina", "elle"], "n": ["er", "son", "ett"]}, "cyrillic": {"m": ["ан", "ир"], "f": ["ана", "ия"], "n": ["енко", "ич"]},
    "greek": {"m": ["ος", "ης"], "f": ["ια", "η"], "n": ["ιδης", "ου"]}, "han": {"m": ["伟"], "f": ["丽"], "n": [""]},
}

def _any_of(words) -> str:
    """A pattern for any of the words, the longest first, that looks at each letter once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + _any_of(rest) for c, rest in sorted(heads.items()) if c]
    return "" if not parts else (f"(?:{'|'.join(parts)})" if len(parts) > 1 or "" in heads else parts[0]) + ("?" if "" in heads else "")


_ALL = lambda d: _any_of(sorted({w for ws in d.values() for w in ws}))
_CAP = r"[^\W\d_][\w'’-]*"
_ENTITY = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<ip6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
    r"|(?<![\w.+-])0(?:\d{8,11}|\d{1,4}(?P<gap>[ ./-])\d{2,8}(?:(?P=gap)\d{2,8}){0,4})(?![\w-])|(?<![\w.,+-])[2-9]\d{9}(?![\w-]|[.,]\d))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    rf"|(?P<titled>(?<!\w)(?P<title>{_ALL(TITLES)})\.?[ ]+(?P<one>{_CAP})(?:[ ]+(?P<two>{_CAP})(?:[ ]+(?P<three>{_CAP}))?)?)"
    rf"|(?P<cued>(?<!\w)(?:{'|'.join(CUES)})(?: ?[:,])?[ ]+(?P<first>{_CAP})[ ]+(?P<second>{_CAP})(?:[ ]+(?P<third>{_CAP}))?)"
    rf"|(?P<named>(?<!\w)(?P<given>{_ALL(GIVEN)})[ ]+(?P<last>{_CAP})(?:[ ]+(?P<more>{_CAP}))?)"
)
#: What a text must hold for an entity to be possible, as a Java pattern. Digits newer than Java's tables are unassigned there.
TRIGGER = rf"[\p{{Nd}}\p{{Cn}}@]|AKIA|gh[pousr]_|sk-|[0-9A-Fa-f]{{32}}|(?=[A-ZnκͰ-ӿ])(?<![\p{{L}}\p{{N}}_])(?:{_ALL(TITLES)}|{_ALL(GIVEN)}|{'|'.join(CUES)})(?![\p{{L}}\p{{N}}_])"
_GENDER = {w.lower(): g for g, ws in GIVEN.items() for w in ws}
_TITLE = {w: g for g, ws in TITLES.items() for w in ws}


def _alnum(s: str) -> str:
    return "".join(c for c in s if c.isalnum())


def _ascii_digits(s: str) -> str:
    return s if s.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in s)


_OPENS = re.compile(r"(?:^|[.!?:;\n\"'“”«»(¿¡-])\s*$")
_NEXT = re.compile(r"\W+(\w+)")


def _again(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The further mentions of the name parts found: whole words that aren't within another entity.

    A part may be a common word too (the text has it in lower case). Where such a word opens a sentence, it is left only
    before a word that it has been seen before in lower case (``green people``: ``Green people``, not ``Green said``)."""
    names: dict[str, str] = {}
    for _, _, kind, canon in found:
        if kind.startswith("name") and (len(canon) > 1 or _script(canon) == "han"):
            names.setdefault(canon, kind)
    if not names:
        return []
    words = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, names), key=lambda w: (-len(w), w)))})(?!\w)", re.I)
    follower = lambda m: (n[1].lower() if (n := _NEXT.match(text, m.end())) else "")
    hits, common, at = [], set(), 0
    for m in words.finditer(text):
        while at < len(found) and found[at][1] <= m.start():
            at += 1
        canon = m[0].lower()
        if canon not in names or at < len(found) and found[at][0] < m.end():
            continue
        if m[0][0].isupper() or _script(m[0]) == "han":
            hits.append((m, canon))
        elif canon not in _GENDER:
            common.add((canon, follower(m)))
    seen = {c for c, _ in common}
    opens = lambda m: _OPENS.search(text, max(0, m.start() - 16), m.start()) is not None
    return [(m.start(), m.end(), names[c], c) for m, c in hits if c not in seen or (c, follower(m)) not in common or not opens(m)]


_PARTS = {"titled": ("one", "two", "three"), "cued": ("first", "second", "third"), "named": ("given", "last", "more")}


def name_of(word: str) -> str:
    """A name part in lower case, without a possessive ending."""
    name = re.sub("['’]s$", "", word, flags=re.I) or word
    return name.lower() if len(name.lower()) == len(name) else name


def ip6(raw: str) -> str | None:
    """The short form of an IPv6 address that says something: three groups at least, and a digit (``std::dec`` has none)."""
    try:
        address = ipaddress.IPv6Address(raw)
    except ValueError:
        return None
    return address.compressed if sum(map(bool, raw.split(":"))) >= 3 and any(map(str.isdecimal, raw)) else None


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity part, in order, none overlapping."""
    found = []
    for m in _ENTITY.finditer(text):
        kind = next(k for k in ("email", "secret", "iban", "ip", "ip6", "ssn", "phone", "card", "titled", "cued", "named") if m[k] is not None)
        if kind in _PARTS:
            parts = [g for g in _PARTS[kind] if m[g] is not None]
            parts = parts[: next((i for i, g in enumerate(parts) if not m[g][0].isupper() and _script(m[g]) != "han"), len(parts))]
            parts = parts[: next((i for i, g in enumerate(parts) if i and m[g].lower() in FUNCTION), len(parts))]
            if kind != "titled" and len(parts) < 2:
                continue
            if len(parts) == 3 and not (m[parts[0]].lower() in _GENDER or m[parts[1]].lower() in _GENDER):
                parts.pop()
            for g in parts:
                first = g != parts[-1] or (g == "one" and m[g].lower() in _GENDER)
                gender = "n" if not first else _GENDER.get(name_of(m[g]), _TITLE.get(m["title"], "n") if kind == "titled" else "n")
                name = name_of(m[g])
                found.append((m.start(g), m.start(g) + len(name), f"name_{gender}", name))
        elif kind == "ip6":
            if address := ip6(m[0]):
                found.append((m.start(), m.end(), "ip", address))
        elif kind == "phone" and not 9 <= sum(map(str.isdecimal, m[0])) <= 17:
            continue  # a date or another number with a leading zero
        elif kind in ("email", "ip"):
            found.append((m.start(), m.end(), kind, m[0].lower() if kind == "email" else _ascii_digits(m[0])))
        else:
            canon = _ascii_digits(_alnum(m[0]))
            canon = canon[-10:] if kind == "phone" else canon
            found.append((m.start(), m.end(), kind, canon if kind == "secret" and not re.fullmatch("[0-9a-fA-F]+", canon) else canon.lower()))
    return sorted(found + _again(text, found))


def _script(s: str) -> str:
    for c in s:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
        if "一" <= c <= "鿿":
            return "han"
    return "latin"


class _Stream:
    """Numbers from a keyed hash of the entity and the attempt."""

    def __init__(self, key: bytes, *of: object):
        self.key, self.of, self.at, self.left = key, "\0".join(map(str, of)), 0, 0

    def below(self, n: int) -> int:
        if self.left < n * 4096:
            digest = hashlib.blake2b(f"{self.of}\0{self.at}".encode(), key=self.key, digest_size=32).digest()
            self.at += 1
            self.left, self.value = 1 << 256, int.from_bytes(digest, "big")
        self.left //= n
        self.value, out = divmod(self.value, n)
        return out


def _pattern(s: str, rnd: _Stream, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Digits become digits, letters letters of their case; letters without case become letters close by in their script."""
    out = []
    for c in s:
        if c.isdigit():
            out.append(str(rnd.below(10)))
        elif c.islower() or c.isupper():
            x = letters[rnd.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        elif c.isalpha():
            near = [x for x in map(chr, range(ord(c) & ~63, (ord(c) & ~63) + 64)) if x.isalpha() and x.lower() == x.upper()]
            out.append(near[rnd.below(len(near))])
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def candidate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """A canonical surrogate; the same for the same arguments everywhere. Late attempts make longer ones."""
    rnd = _Stream(key, kind, canon, attempt)
    longer = max(0, attempt - 4)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        body, _, top = domain.rpartition(".")
        return f"{_pattern(local, rnd)}{_pattern('x' * longer, rnd)}@{_pattern(body, _Stream(key, 'domain', domain))}.{top}"
    if kind == "secret":
        if canon.startswith(("AKIA", "gh", "sk-")) or not re.fullmatch("[0-9a-f]+", canon):
            head = re.match(r"AKIA|gh[pousr]|sk", canon)
            at = head.end() if head else 0
            return canon[:at] + _pattern(canon[at:] + "x" * longer, rnd)
        return "".join("0123456789abcdef"[rnd.below(16)] for _ in canon + "0" * longer)
    if kind == "ip" and ":" in canon:
        return f"fd{rnd.below(256):02x}:" + ":".join(f"{rnd.below(65536):x}" for _ in range(7 if not longer else 5)) + (f"::{rnd.below(65535) + 1:x}" if longer else "")
    if kind == "ip":
        return ".".join(str(1 + rnd.below(254)) for _ in range(4)) if not longer else "fd00:" + ":".join(f"{rnd.below(65536):04x}" for _ in range(7))
    if kind == "iban":
        body = _pattern(canon[4:] + "0" * longer, rnd)
        number = int("".join(str(int(c, 36)) for c in body + canon[:2] + "00"))
        return f"{canon[:2]}{98 - number % 97:02d}{body}"
    if kind == "card":
        out = canon[0] + _pattern(canon[1:] + "0" * longer, rnd)
        if _luhn(canon) == 0:
            out = next(out[:-1] + d for d in "0123456789" if _luhn(out[:-1] + d) == 0)
        return out
    if kind in ("phone", "ssn"):
        if kind == "phone" and canon[0] == "0":  # a national number keeps its leading zero
            return "0" + str(1 + rnd.below(9)) + _pattern(canon[2:] + "0" * longer, rnd)
        return str(2 + rnd.below(8)) + _pattern(canon[1:] + "0" * longer, rnd)
    script, gender = _script(canon), kind[-1]
    stems = STEMS[script]
    made = "".join(stems[rnd.below(len(stems))] for _ in range(2 + attempt // 4))
    return made + ENDS[script][gender][rnd.below(len(ENDS[script][gender]))]


def render(raw: str, kind: str, canon: str) -> str:
    """The canonical surrogate in the format of the mention; what is longer than the mention stands at its end."""
    digit = next((c for c in raw if c.isdecimal() and not c.isascii()), None) if kind != "email" else None
    if digit:
        zero = ord(digit) - unicodedata.decimal(digit)
        return "".join(chr(zero + int(c)) if c.isdecimal() else c for c in render(_ascii_digits(raw), kind, canon))
    if kind == "ip":
        return canon
    if kind.startswith("name"):
        return canon.upper() if raw.isupper() and len(raw) > 1 else canon[:1].upper() + canon[1:]
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(raw, canon, strict=True)) if len(raw) == len(canon) else canon
    spare = sum(map(str.isalnum, raw)) - len(canon) if kind == "phone" else 0
    new = iter(_alnum(raw)[: max(0, spare)] + _alnum(canon))
    out = [next(new, "") if c.isalnum() else c for c in raw]
    return "".join(n.upper() if c.isupper() else n for c, n in zip(raw, out, strict=True)) + "".join(new)


def _found(batches):
    for b in slices(batches):
        rows = [(i, h, n, *m) for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, m in enumerate(mentions(t))]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "h", "n", "start", "end", "kind", "canon"])


def entities_of(found: DataFrame) -> DataFrame:
    """kind, canon and form of each distinct entity: the form is the kind, and for a name has the gender that most mentions tell."""
    kind = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind")).alias("kind")
    said = F.sum(F.expr("CASE kind WHEN 'name_m' THEN 1 WHEN 'name_f' THEN -1 ELSE 0 END")).alias("said")
    gender = F.expr("CASE WHEN kind <> 'name' THEN kind WHEN said > 0 THEN 'name_m' WHEN said < 0 THEN 'name_f' ELSE 'name_n' END")
    return found.withColumn("kind_of", kind).select(F.col("kind_of"), "kind", "canon").groupBy(F.col("kind_of"), "canon").agg(said).withColumnRenamed("kind_of", "kind").select("kind", "canon", gender.alias("form"))


def surrogates(entities: DataFrame, key: str, attempts: int = 64) -> DataFrame:
    """kind, canon and its surrogate for rows of kind, canon and form: distinct within a kind, and none of them an entity of the corpus."""
    secret = key.encode()

    def draw(attempt):
        def run(batches):
            for b in batches:
                pairs = zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([candidate(secret, k, c, attempt) for k, c in pairs], pa.string())], names=["kind", "canon", "surrogate"])

        return run

    spark = entities.sparkSession
    folder, taken, left = f"{shared_dir(spark)}/voxlake-{uuid.uuid4().hex}", entities.select("kind", F.col("canon").alias("surrogate")), entities
    for attempt in range(attempts):
        drawn = in_arrow(left.select("kind", "canon", "form"), draw(attempt), "kind string, canon string, surrogate string")
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).write.parquet(f"{folder}/attempt={attempt}")
        done = spark.read.schema("kind string, surrogate string, canon string").option("basePath", folder).parquet(folder)
        left = stored(left.join(done, ["kind", "canon"], "left_anti").select("kind", "canon", "form"))
        if left.isEmpty():
            return done
        taken = entities.select("kind", F.col("canon").alias("surrogate")).union(done.select("kind", "surrogate"))
    raise ValueError(f"{attempts} attempts left entities without a surrogate of their own")


def key_of(spark: SparkSession) -> str:
    """The key of the session: its setting spark.voxlake.pii.key, drawn at random where it is unset."""
    key = spark.conf.get("spark.voxlake.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("spark.voxlake.pii.key", key)
    return key


def surrogated(docs: DataFrame, key: str, id_column: str = "doc_id", counted: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``counted`` names a further column for the number of mentions replaced."""
    may = F.coalesce(F.col("text").rlike(TRIGGER), F.lit(False))
    held, free = stored(docs.where(may)), docs.where(~may)  # stored: the pattern is dear, and these rows are read twice
    texts = held.select(F.col(id_column).cast("long"), F.xxhash64("text"), "text")
    found = stored(in_arrow(texts, _found, "doc_id long, h long, n int, start int, end int, kind string, canon string"))
    map_ = surrogates(stored(entities_of(found)), key)
    kind = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    spans = found.distinct().withColumn("kind", kind).join(map_, ["kind", "canon"])
    spans = spans.groupBy(F.col("doc_id").alias("_i"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("_spans"))
    joined = held.join(spans, F.col(id_column).cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64("text") == F.col("_h")), "left").drop("_i", "_h")
    at, names = docs.columns.index("text"), [*docs.columns, *([counted] if counted else [])]

    def put(batches):
        for b in slices(batches):
            texts = []
            for t, spans_ in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if spans_:
                    out, done = [], 0
                    for s in spans_:
                        out += [t[done : s["start"]], render(t[s["start"] : s["end"]], s["kind"], s["surrogate"])]
                        done = s["end"]
                    t = "".join([*out, t[done:]])
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    if counted:
        joined = joined.select(*docs.columns, F.coalesce(F.array_size("_spans"), F.lit(0)).cast("long").alias(counted), "_spans")
        free = free.withColumn(counted, F.lit(0).cast("long"))
    return in_arrow(joined, put, free.schema).union(free)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogated(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark), counted="n_replaced")
