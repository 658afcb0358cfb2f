"""Personal data replaced by keyed, type-consistent surrogates.

Every detected entity has a kind and a canonical form, so that all its spellings are
one entity.  The corpus-wide vocabulary of entities is given surrogates by an HMAC of
kind, form and attempt; those that are taken, by another entity or by one that really
occurs, are drawn again.  A mention is then written in the surrogate's place with the
mention's own format, script and gender.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import as_id, map_arrow, read, stage

GIVEN = {
    ("latin", "f"): "Anna Maria Laura Sophie Julia Emma Clara Lucia Elena Carmen Sarah Emily Hannah Charlotte Alice Camille Claire Juliette Manon Ingrid Katrin Sabine Ursula Heike Isabel Pilar Rosa Teresa Olivia Grace Nancy Susan Linda Barbara Patricia Jennifer Monique Brigitte Renate Beatriz",
    ("latin", "m"): "John James Robert Michael William David Thomas Peter Paul Hans Klaus Jürgen Stefan Andreas Pierre Jean François Antoine Louis Jacques Juan Carlos Miguel José Antonio Luis Pablo Javier George Edward Henry Charles Frank Walter Martin Daniel Samuel Oliver Lukas Felix",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Дарья Екатерина Галина",
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Николай Михаил Владимир Павел Юрий Олег",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Βασιλική Γεωργία Δέσποινα",
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης Χρήστος Ανδρέας",
    ("arabic", "f"): "فاطمة عائشة مريم خديجة زينب ليلى سلمى نور",
    ("arabic", "m"): "محمد أحمد علي حسين خالد عمر يوسف إبراهيم",
    ("hebrew", "f"): "שרה רחל לאה מרים רבקה נועה תמר אסתר",
    ("hebrew", "m"): "משה דוד יוסף אברהם יעקב יצחק שמואל דניאל",
}
GIVEN = {k: v.split() for k, v in GIVEN.items()}
_GENDER = {n.lower(): g for (_, g), ns in GIVEN.items() for n in ns}
_TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "dr": "", "prof": "", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f", "señor": "m", "señora": "f", "sr": "m", "sra": "f", "г-н": "m", "г-жа": "f", "κύριος": "m", "κυρία": "f"}
#: Titles as they are written before a name: capitalised, in some languages also not.
_WRITTEN = {t[0].upper() + t[1:] for t in _TITLES} | {t for t in _TITLES if not t.isascii()} | {"madame", "monsieur"}
_PARTS = {"latin": "bal ber cor dan del fen gar hol kar lan lor mar men nor pel ran sal ter val wen".split(), "cyrillic": "бал бер вор дан зел кар лан мор нев пол рас сол тер чер".split(), "greek": "βαλ δαν καρ λαμ μαν νικ παλ ραν σαλ τερ".split()}
_ENDS = {"latin": "son man er sen ley ton".split(), "cyrillic": ["ов", "ев", "ин"], "greek": ["ίδης", "άκης", "όπουλος"]}

_U = r"[^\W\d_]"
PATTERNS = [
    ("email", r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+\w{2,}"),
    ("secret", r"\bAKIA[0-9A-Z]{16}\b|(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)([^\s\"',;]{6,})"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\d.-])(?:\d{13,19}|\d{4}(?P<csep>[ -])\d{4}(?P=csep)\d{4}(?P=csep)\d{1,7}|\d{4}(?P<asep>[ -])\d{6}(?P=asep)\d{5})(?![\d-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
    ("ip6", r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){2,7}(?::?[0-9a-fA-F]{1,4})+(?![\w:])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-]|\.\d)|(?<![\w+])\+\d{8,15}\b"),
]
_NAME = rf"(?:\b(?i:{'|'.join(sorted(map(re.escape, _TITLES), key=len, reverse=True))})\b\.? +)?(?:{'|'.join(sorted(map(re.escape, (n for ns in GIVEN.values() for n in ns)), key=len, reverse=True))})(?:[ -]+{_U}[\w'’-]+)?|\b(?:{'|'.join(sorted(map(re.escape, _WRITTEN), key=len, reverse=True))})\.? +{_U}[\w'’-]+(?: +{_U}[\w'’-]+)?"
_SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_NAMES = re.compile(rf"(?<!\w)(?:{_NAME})(?!\w)")


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    form: str
    gender: str


def luhn_ok(digits: str) -> bool:
    return _luhn(digits) == 0


def _luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def script_of(word: str) -> str:
    """The script of a word's first letter that isn't Latin, in lower case ("cjk", "arabic"), else latin."""
    for c in word:
        if c.isalpha() and not "A" <= c <= "z":
            name = unicodedata.name(c, "LATIN").split()[0].split("-")[0].lower()
            if name not in ("latin", "modifier", "feminine", "masculine", "micro"):
                return name
    return "latin"


def detect(text: str | None) -> list[Mention]:
    """Entities of a text, in order, without overlaps.

    Kinds: email, phone (8 to 15 digits), card (13 to 19 digits of a right check
    digit), iban (of right check digits), ssn, ip, ip6, secret, given (names of the
    lists), surname (a capitalised word after a given name or a title).
    """
    text = text or ""
    out: list[Mention] = []
    if _DIGIT.search(text) or "@" in text or _SECRET.search(text):
        at = 0
        while m := _SCAN.search(text, at):
            kind, (a, b) = m.lastgroup, m.span()
            if kind == "secret" and m.group(_INNER) is not None:
                a, b = m.span(_INNER)
            if form := _form(kind, text[a:b]):
                out.append(Mention(a, b, *form, ""))
                at = m.end()
            else:  # something else may start inside of what only looked like an entity
                at = _RUN.match(text, m.start()).end()
    if _CAPITAL.search(text):
        taken = [(m.start, m.end) for m in out]
        for m in _NAMES.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out += _names(text, m.start(), m.end())
    return sorted(out)


_INNER = next(i for i in range(1, _SCAN.groups + 1) if i not in _SCAN.groupindex.values())  # the secret itself, after its name
_RUN = re.compile(r"\w+|\W")
#: What every pattern without an "@" or a secret's name implies.
_DIGIT = re.compile(r"\d|[a-fA-F]:[a-fA-F]")
_SECRET = re.compile(r"(?i)passw|pwd|secret|token|api.?key|AKIA")
_CAPITAL = re.compile("|".join(sorted({re.escape(n) for ns in GIVEN.values() for n in ns} | {re.escape(t) + r"\.? " for t in _WRITTEN})))


def _form(kind: str, said: str) -> tuple[str, str] | None:
    digits = re.sub(r"\D", "", said)
    if kind in ("email", "secret"):
        return kind, said.lower() if kind == "email" else said
    if kind == "iban":
        plain = said.replace(" ", "")
        return (kind, plain) if 15 <= len(plain) <= 34 and iban_ok(plain) else None
    if kind == "card":
        return (kind, digits) if luhn_ok(digits) and len(set(digits)) > 1 else None
    if kind == "ssn":
        return kind, digits
    if kind in ("ip", "ip6"):
        try:
            return kind, str(ipaddress.ip_address(said))
        except ValueError:
            return None
    if not 8 <= len(digits) <= 15 or (said[0] not in "+(" and len(digits) < 9) or re.fullmatch(r"(?:19|20)\d\d[ .-]\d\d[ .-]\d\d(?:[ .-]\d\d)*", said):
        return None
    return kind, "1" + digits if len(digits) == 10 and said[0] != "+" else digits


def _names(text: str, start: int, end: int) -> Iterator[Mention]:
    gender, given = "", False
    for m in re.finditer(r"[\w'’]+(?:-[\w'’]+)*", text[start:end]):
        word, a, b = m.group(), start + m.start(), start + m.end()
        low = word.lower()
        if low in _TITLES and not given:
            gender = _TITLES[low]
        elif not word[0].isupper() and not (_caseless(word) and (low in _GENDER and not given or gender and not given)) or word.isupper() and len(word) > 1:
            return
        elif low in _GENDER and not given:
            gender, given = _GENDER[low], True
            yield Mention(a, b, "given", f"{script_of(word)}:{gender}:{low}", gender)
        else:
            script = script_of(word)
            stem = low[:-1] if script == "cyrillic" and low.endswith(("ова", "ева", "ина")) and gender != "m" else low
            yield Mention(a, b, "surname", f"{script}:{stem}", "f" if stem != low else gender)
            return


def _caseless(word: str) -> bool:
    """Whether a word's script has no capitals; such words are names only if listed or after a title."""
    return unicodedata.category(word[0]) == "Lo"


# --- surrogates ----------------------------------------------------------------


class _Draw:
    """A stream of numbers keyed by key, kind, form and attempt."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.seed, self.n, self.pool, self.left = hmac.new(key, "\0".join(map(str, what)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, 0, 0

    def below(self, n: int) -> int:
        if self.left < 48:
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "little")).digest(), "little")
            self.n, self.left = self.n + 1, 256
        x, self.pool, self.left = self.pool % n, self.pool // n, self.left - max(1, n.bit_length())
        return x


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


@lru_cache(4096)
def _kin(c: str) -> str:
    """Characters of the script, case and class of a letter or digit."""
    if "0" <= c <= "9" or not c.isalpha() and unicodedata.category(c) != "Nd":
        return _ALPHABETS[0]
    if not c.isalpha():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    script = script_of(c)
    if script in ("latin", "cyrillic", "greek"):
        return _ALPHABETS[{"latin": 1, "cyrillic": 3, "greek": 5}[script] + c.isupper()]
    page = range(ord(c) & ~0xFF, (ord(c) | 0xFF) + 1)
    return "".join(x for x in map(chr, page) if unicodedata.category(x) == unicodedata.category(c) and script_of(x) == script)


def _like(s: str, draw: _Draw, hexed: bool = False) -> str:
    """Every letter and digit drawn again from its own script, case and class."""
    out = []
    for c in s:
        if hexed and c in "0123456789abcdef":
            out.append("0123456789abcdef"[draw.below(16)])
        elif c.isalnum():
            a = _kin(c)
            out.append(a[draw.below(len(a))])
        else:
            out.append(c)
    return "".join(out)


_PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")]


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The canonical surrogate of an entity at an attempt; attempts differ in what they draw.

    Later attempts draw from wider spaces, in the end by longer strings (addresses of
    version 6 for those of version 4), so that no corpus can use up a kind.
    """
    draw = _Draw(key, kind, form, attempt)
    wider = max(0, attempt - 10) // 3  # digits or characters more
    if kind == "email":
        local, _, domain = form.rpartition("@")
        labels = domain.split(".")
        host = ".".join(_like(x, _Draw(key, "domain", domain, i)) for i, x in enumerate(labels[:-2])) or _like(labels[0], _Draw(key, "domain", domain))
        extra = _like("aaa" * (attempt // 6), draw)
        return f"{_like(local, draw)}{extra}@{host}.example.{('com', 'net', 'org')[_Draw(key, 'tld', domain).below(3)]}"
    if kind == "phone":
        if len(form) == 11 and form[0] == "1":
            return "1" + str(2 + draw.below(8)) + _like("00", draw) + ("555" if form[4:7] == "555" and attempt < 8 else str(2 + draw.below(8)) + _like("00", draw)) + _like("0000" + "0" * wider, draw)
        return form[:2] + _like(form[2:] + form[-1] * wider, draw)
    if kind == "card":
        body = form[0] + _like(form[1:-1], draw)
        return body + str(-_luhn(body + "0") % 10)
    if kind == "iban":
        body = _like(form[4:], draw)
        return form[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + form[:2] + '00')) % 97:02d}" + body
    if kind == "ssn":
        return "9" + _like(form[1:] + "0" * wider, draw)
    if kind == "ip":
        old = ipaddress.ip_address(form)
        if attempt < 24:
            own = next((n for n in _PRIVATE if old in n), None)
            if own and attempt >= 8:
                own = _PRIVATE[0]
            if own or old.is_private:
                own = own or _PRIVATE[0]
                return str(own[draw.below(own.num_addresses)])
            return str(ipaddress.ip_address((240 << 24) + draw.below((15 << 24))))  # a range that nobody is given
        kind = "ip6"
    if kind == "ip6":
        return str(ipaddress.ip_address((0x20010DB8 << 96) + (draw.below(1 << 48) << 48) + draw.below(1 << 48)))
    if kind == "secret":
        head = "AKIA" if form.startswith("AKIA") else ""
        rest = form[len(head) :]
        return head + _like(rest + rest[:1] * wider, draw, hexed=bool(re.fullmatch(r"[0-9a-f]{8,}", form)))
    if kind == "given":
        script, gender, _ = form.split(":")
        names = GIVEN[script, gender]
        first = names[draw.below(len(names))]
        return first if attempt < 6 else "-".join([first, *(names[draw.below(len(names))] for _ in range(1 + (attempt - 6) // 4))])
    script, stem = form.split(":", 1)
    if script not in _PARTS:
        return _like(stem + stem[-1:] * wider, draw)
    parts, ends = _PARTS[script], _ENDS[script]
    n = 2 + attempt // 3
    return "".join(parts[draw.below(len(parts))] for _ in range(n)).capitalize() + ends[draw.below(len(ends))]


def canonical(kind: str, new: str) -> str:
    """The form under which a surrogate would be detected, to be held against real entities."""
    if kind == "given":
        return f"{script_of(new)}:{_GENDER.get(new.lower(), '')}:{new.lower()}"
    if kind == "surname":
        return f"{script_of(new)}:{new.lower()}"
    return new


def render(said: str, m: Mention, new: str) -> str:
    """A surrogate in the format of a mention: its separators, grouping, case and gender."""
    if m.kind in ("phone", "card", "ssn"):
        n = sum(c.isdigit() for c in said)
        digits = iter(new[len(m.form) - n : len(m.form)])
        return "".join(next(digits) if c.isdigit() else c for c in said) + new[len(m.form) :]
    if m.kind == "iban":
        rest = iter(new)
        return "".join(next(rest) if c != " " else c for c in said)
    if m.kind == "email":
        return new.upper() if said.isupper() else new
    if m.kind == "surname" and m.gender == "f" and new.endswith(("ов", "ев", "ин")):
        return new + "а"
    return new


def replace(text: str, mentions: list[Mention], mapping: dict[tuple[str, str], str]) -> tuple[str, list[tuple[int, int]]]:
    """The text with each mention's surrogate, and where these stand in the new text."""
    out, at, spans, size = [], 0, [], 0
    for m in mentions:
        new = render(text[m.start : m.end], m, mapping[m.kind, m.form])
        out += [text[at : m.start], new]
        size += m.start - at + len(new)
        spans.append((size - len(new), size))
        at = m.end
    return "".join([*out, text[at:]]), spans


# --- over documents -------------------------------------------------------------


def assign_surrogates(entities: DataFrame, key: str, max_attempts: int = 64) -> DataFrame:
    """(kind, form) to (kind, form, new): distinct entities have distinct surrogates, none of which really occurs.

    Each round draws for all entities that are still open.  A draw is refused if it
    equals an entity of the corpus or an earlier surrogate; of several that draw the
    same, the smallest form takes it.  All of this is grouping and joining on the
    surrogate; a round is staged, and a second round concerns few.
    """
    open_ = stage(entities.distinct(), "entities")
    real = open_.select("kind", F.col("form").alias("shape"))
    taken = None
    raw = key.encode()
    for attempt in range(max_attempts):

        def draw(batches: Iterator[pa.RecordBatch], attempt=attempt) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds, forms = b.column(0).to_pylist(), b.column(1).to_pylist()
                new = [surrogate(raw, k, f, attempt) for k, f in zip(kinds, forms)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string()), pa.array([canonical(k, n) for k, n in zip(kinds, new)], pa.string())], names=["kind", "form", "new", "shape"])

        drawn = stage(map_arrow(open_.select("kind", "form"), draw, "kind string, form string, new string, shape string"), "drawn")
        free = drawn.join(real, ["kind", "shape"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "shape"), ["kind", "shape"], "left_anti")
        won = free.groupBy("kind", "shape").agg(F.min(F.struct("form", "new")).alias("w")).select("kind", F.col("w.form").alias("form"), F.col("w.new").alias("new"), "shape")
        taken = stage(won if taken is None else taken.unionByName(won), "surrogates")
        open_ = stage(open_.join(taken.select("kind", "form"), ["kind", "form"], "left_anti"), "entities")
        if open_.isEmpty():
            return taken.select("kind", "form", "new")
    raise RuntimeError(f"entities are left without a surrogate after {max_attempts} attempts")


def anonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rid of personal data, and ``entities`` (kind, and place in the new text).

    Entities that are equal in the whole corpus have one surrogate, others never share
    one.  Texts are scanned once and staged with their mentions; only documents with an
    entity are shuffled.  Null texts stay null; null ids and repeated rows are handled
    like any other row; an existing column ``entities`` is replaced; texts without an
    entity come back unchanged.
    """
    docs = docs.drop("entities")
    names = docs.columns
    text_at = names.index(text_col)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("entities array<struct<kind:string,start:int,end:int>>").fields])
    arrow = to_arrow_schema(schema)
    found_schema = StructType([*docs.schema.fields, *StructType.fromDDL("__tm_m array<struct<start:int,end:int,kind:string,form:string,gender:string>>").fields])
    found_arrow = to_arrow_schema(found_schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [[m._asdict() for m in detect(t)] for t in b.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, found_arrow.field(len(names)).type)], schema=found_arrow)

    found = map_arrow(docs, find, found_schema).withColumn("__tm_k", F.struct(as_id(id_col).alias("d"), F.xxhash64(text_col).alias("h")))
    found = stage(found.withColumn("__tm_hit", F.size("__tm_m") > 0), "private")
    clean = found.where(~F.col("__tm_hit")).select(*names, F.array().cast(schema[-1].dataType).alias("entities"))
    hits = found.where("__tm_hit")
    mentions = hits.select("__tm_k", F.explode("__tm_m").alias("m")).select("__tm_k", "m.kind", "m.form").distinct()
    mapping = assign_surrogates(mentions.select("kind", "form"), key)
    held = stage(mentions.join(mapping, ["kind", "form"]).groupBy("__tm_k").agg(F.collect_list(F.struct("kind", "form", "new")).alias("__tm_s")), "surrogates-of")
    joined = hits.join(held, "__tm_k").select(*names, "__tm_m", "__tm_s")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, places = [], []
            for t, said, s in zip(*(b.column(i).to_pylist() for i in (text_at, len(names), len(names) + 1))):
                ms = [Mention(**m) for m in said]
                new, spans = replace(t, ms, {(x["kind"], x["form"]): x["new"] for x in s})
                texts.append(new)
                places.append([{"kind": m.kind, "start": a, "end": e} for m, (a, e) in zip(ms, spans)])
            cols = [pa.array(texts, arrow.field(text_at).type) if i == text_at else c for i, c in enumerate(b.columns[:-2])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(places, arrow.field(len(names)).type)], schema=arrow)

    return clean.unionByName(map_arrow(joined, write, schema))


#: The key of the query; in use it is a secret of whoever runs the pipeline.
QUERY_KEY = "surrogates of the query"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = anonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return got.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",").alias("kinds"))
