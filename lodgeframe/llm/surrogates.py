"""Personal data replaced by keyed surrogates of the same kind and form.

Detected entities are e-mail addresses, telephone numbers (international, in brackets, or three, three and four digits), IPv4 and IPv6
addresses, payment card numbers (16 digits in groups of four or together), bank account numbers with a right check (IBAN), social
security numbers (123-45-6789), and names: after a title (Mr, Mrs, Ms, ...), full ones after a salutation, an
introduction or above a signature, and wherever a name known in one of these ways stands again in the same document.

Each gets a replacement that follows from ``secret`` and keeps its type and format: digits become digits in the same grouping, card and
account numbers keep whether their check digits are right, an address of a private network stays in one, letters keep their case, a mail
address keeps the length class and the dots of its parts, a given name keeps its gender, and any name keeps its script.

Coreference: the same entity (after lower-casing) has the same surrogate in every document, and the given and
family names of a full name are replaced as they are alone. Distinctness: entities whose format has a fixed number of values (numbers and network
addresses) are permuted within it by a keyed permutation without fixed points (a Feistel network, walked until it stays in the
format), so they are distinct by construction, however full the format is; where it is full, a surrogate is another real value.
Names and mail addresses have formats without end: all of them and their surrogates are tabled; where two would share a surrogate, or a
surrogate is itself an entity of the corpus, all but the first get the next of their keyed sequence, until there is no collision.

Cases: a null text stays null and has no entities; empty and very long texts are treated like any
other; repeated rows get the same text; empty tables give empty results. Further columns are kept; where one has the name
of an added column, the added ones get more underscores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodgeframe.llm.bloom import split
from lodgeframe.llm.columns import free_prefix, widened
from lodgeframe.llm.storage import stored, unsent
from lodgeframe.llm.textarrays import slices

TITLES = "Mr Mrs Ms Miss Sir Lady Lord Herr Frau Señor Señora Sr Sra Monsieur Madame Mme Г-н Г-жа Κύριος Κυρία".split()
#: What a title says of gender, where a given name is unknown.
FEMALE_TITLES = {"mrs", "ms", "miss", "lady", "frau", "señora", "sra", "madame", "mme", "г-жа", "κυρία"}
#: Given names by script and gender, and family names by script.
GIVEN = {
    ("latin", "f"): "Anna Clara Diana Elena Frida Greta Helen Ingrid Julia Karen Laura Maria Nora Olivia Paula Rosa Sarah Teresa Vera Wanda".split(),
    ("latin", "m"): "Adam Boris Carl David Erik Felix Georg Henry Ivan Jonas Karl Lukas Martin Niels Oscar Peter Ralf Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("greek", "f"): "Άννα Βάσω Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χαρά".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Μάριος Νίκος Πέτρος Στέλιος".split(),
}
FAMILY = {
    "latin": "Abbott Barnes Carver Dalton Ellis Foster Granger Holden Iverson Jensen Keller Lambert Mercer Norton Osborne Palmer Quincy Reeves Sutton Turner".split(),
    "cyrillic": "Белов Волков Громов Дроздов Ершов Жуков Зимин Котов Лапин Марков".split(),
    "greek": "Αγγέλου Βλάχος Γεωργίου Δήμου Ιωάννου Κανάκης Λάμπρου Μακρής Νικολάου Παππάς".split(),
}
_GENDER = {name.lower(): gender for (_, gender), names in GIVEN.items() for name in names}

_CAPITAL = r"[^\W\d_a-zà-ÿа-яά-ώ][^\W\d_]+"
_MAIL = r"(?P<mail>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,6}[A-Za-z]{2,24})"
_CARD = r"(?P<card>(?<![\d.])(?:\d{16}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3})(?![\d.]\d|\d))"
_IP = r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d))"
_PHONE = (
    r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,5}){1,4}(?!\d)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+-])\d{3}(?: \d{3} |-\d{3}-|\.\d{3}\.)\d{4}(?![\w-]|\.\d))"
)
_SOCIAL = r"(?P<social>(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d))"
_ACCOUNT = r"(?P<account>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
_IP6 = r"(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]|:))"
_ANY_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_NAME = rf"(?:(?:{_ANY_TITLE})\.? )(?P<name>{_CAPITAL}(?: {_CAPITAL})?)"
#: What comes before a full name besides a title.
_OPENING = r"(?:Dear |My name is |[Rr]egards,?\n+ *|[Ss]incerely,?\n+ *|[Cc]heers,?\n+ *|Grüße[n]?,?\n+ *|Cordialement,?\n+ *|Saludos,?\n+ *)"
_FULL = rf"{_OPENING}(?!(?:{_ANY_TITLE})\b)(?P<full>{_CAPITAL} {_CAPITAL})(?!\w)"


PATTERN = re.compile("|".join([_MAIL, _ACCOUNT, _CARD, _IP, _PHONE, _SOCIAL, _IP6, _NAME, _FULL]))
#: A text that this does not match has no entity; it is quick to refuse.
HINT = re.compile(rf"@|\+\d|\d\d\d|\d\.\d|[A-Z][A-Z]\d\d|:[0-9A-Fa-f]{{0,4}}:|(?:{_ANY_TITLE})\.? |{_OPENING}")
_WHOLE_CAPITAL = re.compile(rf"(?<!\w){_CAPITAL}(?!\w)")
#: Kinds whose format has a fixed number of values.
PERMUTED = ("card", "phone", "ip", "ip6", "account", "social")


def account_check(account: str) -> int:
    """The check number that makes an account number (country, two digits, rest) right."""
    return 98 - int("".join(str(int(c, 36)) for c in account[4:] + account[:2] + "00")) % 97


def _account(found: str) -> str | None:
    """The part of a candidate that is an account number: all of it, or without groups at its end."""
    while len(plain := found.replace(" ", "")) >= 15:
        if len(plain) <= 34 and int(plain[2:4]) == account_check(plain):
            return found
        found = found[: found.rfind(" ")] if " " in found else ""
    return None


def _address(found: str) -> bool:
    try:
        return int(IPv6Address(found)) >> 16 > 0
    except AddressValueError:
        return False


def _named(start: int, name: str, title: str | None) -> list[tuple[int, int, str, str]]:
    given, _, family = name.partition(" ")
    if not family:
        return [(start, start + len(given), "family", given)]
    gender = _GENDER.get(given.lower(), "f" if title in FEMALE_TITLES else "m")
    return [(start, start + len(given), f"given-{gender}", given), (start + len(given) + 1, start + len(name), "family", family)]


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of every entity, in order; a name's gender follows its kind."""
    if not text or not HINT.search(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    at = 0
    while m := PATTERN.search(text, at):
        kind = next(k for k in ("mail", "account", "card", "ip", "phone", "social", "ip6", "name", "full") if m[k] is not None)
        start, end = m.span(kind)
        if kind == "account":
            held = _account(m[kind])
            end = start + len(held or "")
        if (kind == "account" and held is None) or (kind == "ip6" and not _address(m[kind])):
            at = m.start() + 1  # something else may begin inside
            continue
        if kind in ("name", "full"):
            out += _named(start, m[kind], text[m.start() : start].strip(" .").lower() if kind == "name" else None)
        else:
            out.append((start, end, kind, text[start:end]))
        at = max(end, m.start() + 1)
    known = {normal(kind, name): kind for _, _, kind, name in out if kind == "family" or kind.startswith("given")}
    if known:  # the same names elsewhere in the document
        covered, more = sorted((a, b) for a, b, *_ in out), []
        k = 0
        for m in _WHOLE_CAPITAL.finditer(text):
            while k < len(covered) and covered[k][1] <= m.start():
                k += 1
            free = k == len(covered) or covered[k][0] >= m.end()
            if free and (kind := known.get(m[0].lower())):
                more.append((m.start(), m.end(), kind, m[0]))
        out = sorted(out + more)
    return out


def normal(kind: str, entity: str) -> str:
    """What all forms of one entity have in common."""
    if kind in ("mail", "family") or kind.startswith("given"):
        return entity.lower()
    if kind == "account":
        return entity.replace(" ", "")
    if kind == "ip6":
        return str(IPv6Address(entity))
    return entity if kind == "ip" else re.sub(r"[^\d+]", "", entity)


class Permutation:
    """A keyed permutation of the numbers below ``size`` in which no number stays in place: one cycle through all of them.

    A Feistel network permutes the numbers of so many bits; walking it until the number is below ``size`` permutes
    those. Each number goes to the one whose image is next to its own.
    """

    ROUNDS = 8

    def __init__(self, secret: bytes, name: str, size: int):
        self.secret, self.name, self.size = secret, name.encode() + b"\0", size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _mixed(self, turn: int, value: int) -> int:
        data = self.name + bytes([turn]) + value.to_bytes(self.half // 8 + 1, "big")
        return int.from_bytes(blake2b(data, key=self.secret, digest_size=16).digest(), "big") & self.mask

    def _forward(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for turn in range(self.ROUNDS):
                left, right = right, left ^ self._mixed(turn, right)
            x = left << self.half | right
            if x < self.size:
                return x

    def _backward(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for turn in reversed(range(self.ROUNDS)):
                left, right = right ^ self._mixed(turn, left), left
            x = left << self.half | right
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        return x if self.size < 2 else self._backward((self._forward(x) + 1) % self.size)

    def within(self, x: int, belongs: Callable[[int], bool]) -> int:
        """The same among the numbers that belong; ``x`` does."""
        x = self(x)
        while not belongs(x):
            x = self(x)
        return x


@lru_cache(maxsize=256)
def _permutation(secret: bytes, name: str, size: int) -> Permutation:
    return Permutation(secret, name, size)


def _network(address: int) -> str:
    """The class of IPv4 addresses that an address belongs to."""
    first = address >> 24
    if first in (10, 127):
        return str(first)
    if address >> 16 == 192 << 8 | 168:
        return "192.168"
    if address >> 20 == 172 << 4 | 1:
        return "172.16"
    return "other" if first == 0 or first >= 224 else "public"


_NETWORKS = {"10": (10 << 24, 24), "127": (127 << 24, 24), "192.168": ((192 << 8 | 168) << 16, 16), "172.16": ((172 << 4 | 1) << 20, 20)}


def _moved_digits(secret: bytes, kind: str, kept: str, digits: str) -> str:
    return kept + str(_permutation(secret, f"{kind} {kept} {len(digits)}", 10 ** len(digits))(int(digits))).zfill(len(digits)) if digits else kept


def permuted(secret: bytes, kind: str, entity: str) -> str:
    """The replacement of a normal entity whose format has a fixed number of values: one to one, and never itself."""
    if kind == "card":
        zero, body = entity[0] == "0", int(entity[:-1])
        first = 0 if zero else 10 ** (len(entity) - 2)
        size = 10 ** (len(entity) - 2) * (1 if zero else 9)
        moved = str(_permutation(secret, f"card {zero} {len(entity)}", size)(body - first) + first).zfill(len(entity) - 1)
        off = int(entity[-1]) - int(check_digit(entity[:-1]))
        return moved + str((int(check_digit(moved)) + off) % 10)
    if kind in ("phone", "social"):  # the country code stays, as the form of a number goes with it
        plus = 2 if entity.startswith("+") else 0
        return _moved_digits(secret, kind, entity[:plus], entity[plus:])
    if kind == "ip":
        a, b, c, d = map(int, entity.split("."))
        address = a << 24 | b << 16 | c << 8 | d
        if (name := _network(address)) in _NETWORKS:
            base, bits = _NETWORKS[name]
            address = base + _permutation(secret, f"ip {name}", 1 << bits)(address - base)
        else:
            address = _permutation(secret, f"ip {name}", 1 << 32).within(address, lambda x: _network(x) == name)
        return ".".join(str(address >> k & 255) for k in (24, 16, 8, 0))
    if kind == "ip6":  # the first 16 bits tell the kind of network
        address, low = int(IPv6Address(entity)), (1 << 112) - 1
        return str(IPv6Address(address >> 112 << 112 | _permutation(secret, f"ip6 {address >> 112}", 1 << 112)(address & low)))
    letters = "".join("9" if c.isdigit() else "A" for c in entity[4:])
    value, size = 0, 1
    for c, form in zip(entity[4:], letters):
        base = 10 if form == "9" else 26
        value, size = value * base + (int(c) if base == 10 else ord(c) - 65), size * base
    value, out = _permutation(secret, f"account {entity[:2]} {letters}", size)(value), []
    for form in reversed(letters):
        value, rest = divmod(value, 10 if form == "9" else 26)
        out.append(str(rest) if form == "9" else chr(65 + rest))
    moved = entity[:2] + "00" + "".join(reversed(out))
    return f"{moved[:2]}{account_check(moved):02d}{moved[4:]}"


class _Stream:
    """An endless keyed sequence of numbers for one entity and attempt."""

    def __init__(self, secret: bytes, kind: str, entity: str, attempt: int):
        self.start, self.count, self.held = f"{kind}\0{entity}\0{attempt}".encode(), 0, b""
        self.secret = secret

    def below(self, bound: int) -> int:
        if len(self.held) < 4:
            self.held += blake2b(self.start + b"\0%d" % self.count, key=self.secret, digest_size=64).digest()
            self.count += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value % bound


def check_digit(digits: str) -> str:
    """The last digit that makes the card number valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _script(name: str) -> str:
    first = ord(name[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


def surrogate(secret: bytes, kind: str, entity: str, attempt: int) -> str:
    """The replacement of a normal entity in normal form. Attempts count for names and mail addresses only."""
    if kind in PERMUTED:
        return permuted(secret, kind, entity)
    keyed = _Stream(secret, kind, entity, attempt)
    if kind == "mail":
        local, _, domain = entity.partition("@")
        letters = lambda s: "".join(chr(97 + keyed.below(26)) if c.isalpha() else str(keyed.below(10)) if c.isdigit() else c for c in s)
        name = letters(local)
        name += "".join(chr(97 + keyed.below(26)) for _ in range(max(0, 8 - len(name))))
        return f"{name}@{('' if attempt < 1 else 'n%d.' % attempt)}mail.example.{('com', 'org', 'net')[len(domain) % 3]}"
    script = _script(entity)
    names = FAMILY[script] if kind == "family" else GIVEN[(script, kind[-1])]
    # Lists are short: beyond them names are lengthened, so that any number of them stays distinct.
    chosen = names[keyed.below(len(names))]
    if attempt:
        ends = {"latin": "bcdfgklmnrst", "cyrillic": "бвгдклмнрст", "greek": "βγδκλμνρστ"}[script]
        chosen += "".join(ends[keyed.below(len(ends))] for _ in range(1 + min(attempt, 8)))
    return chosen.lower()


def formatted(kind: str, entity: str, replacement: str) -> str:
    """The replacement in the written form of the entity."""
    if kind in ("card", "phone", "social"):
        left = iter(replacement.lstrip("+"))
        return "".join(next(left) if c.isdigit() else c for c in entity)
    if kind == "account":
        left = iter(replacement)
        return "".join(c if c == " " else next(left) for c in entity)
    if kind == "mail":
        return replacement.upper() if entity.isupper() else replacement
    if kind in ("ip", "ip6"):
        return replacement
    return replacement.upper() if entity.isupper() and len(entity) > 1 else replacement[:1].upper() + replacement[1:]


def occurrences(df: DataFrame, text: str, doc: str) -> DataFrame:
    """(doc, start, end, kind, entity, written) of every entity of every text: the texts are searched this once."""
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = ["doc", "start", "end", "kind", "entity", "written"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [
                    (d, a, b, k, normal(k, e), e) for d, t in zip(*(c.to_pylist() for c in part.columns)) for a, b, k, e in entities(t)
                ]
                columns = list(zip(*found)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    rows = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc binary, start int, end int, kind string, entity string, written string")


def surrogates(mentions: DataFrame, secret: bytes) -> DataFrame:
    """(kind, entity, surrogate), one to one. No name or mail address among the surrogates is an entity of its kind.

    Kinds that are permuted need one pass. Of the others, each round keeps the first entity of every surrogate and lets the others
    take their next one; the rounds follow from the data: as long as there are collisions. Their formats have no end, so they do end.
    """

    def tried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, attempts = (c.to_pylist() for c in batch.columns)
            made = [surrogate(secret, k, e, a) for k, e, a in zip(kinds, names, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "entity", "attempt", "surrogate"])

    schema = "kind string, entity string, attempt int, surrogate string"
    first = stored(mentions.select("kind", "entity", F.lit(0).alias("attempt")).mapInArrow(tried, schema), "surrogates")
    fixed = F.col("kind").isin(*PERMUTED)
    settled, table = first.where(fixed).select("kind", "entity", "surrogate"), first.where(~fixed)
    while True:
        # The first entity of a surrogate is found by partial sums, as many entities may share one.
        firsts = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"))
        real = mentions.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        judged = unsent(table).join(firsts.join(unsent(real), ["kind", "surrogate"], "left"), ["kind", "surrogate"])
        clash = (F.col("first.entity") != F.col("entity")) | F.col("real").isNotNull()
        marked = stored(judged.select("kind", "entity", "attempt", "surrogate", clash.alias("clash")), "marked")
        if marked.where("clash").isEmpty():
            return settled.unionByName(marked.select("kind", "entity", "surrogate"))
        again = marked.where("clash").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        kept = marked.where("NOT clash").select("kind", "entity", "attempt", "surrogate")
        table = stored(kept.unionByName(again.mapInArrow(tried, schema)), "surrogates")


def replacements(found: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, given): every document's entities, in order, with their surrogates. Nothing goes through the driver."""
    # An entity may be in a third of all documents: its table row is copied to every salt.
    salts = 32
    salted = found.distinct().withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    copies = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(unsent(copies), ["kind", "entity", "salt"]).groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "written", "surrogate"))).alias("given")
    )


_ENTITY = StructType(
    [StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType()), StructField("surrogate", StringType())]
)


def pseudonymise(df: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the entities of its text replaced, and _entities array<struct<start,end,kind,surrogate>> of the new text.

    Texts without entities pass straight through; of the others, the entities and, once, the text shuffle.
    """
    prefix = free_prefix(df, "doc", "entities", "given")
    doc, added, given_name = (prefix + name for name in ("doc", "entities", "given"))
    # Rows of equal id and text are one document, told from all others by 128 bits.
    told = F.concat_ws("\0", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\1")), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    whole = df.withColumn(doc, F.unhex(F.md5(told)))
    found = stored(occurrences(whole, text, doc), "occurrences")
    names = surrogates(stored(found.select("kind", "entity").distinct(), "mentions"), secret)
    given = stored(replacements(found, names), "given").select(F.col("doc").alias(doc), F.col("given").alias(given_name))
    possible, clear = split(whole, doc, given.select(doc))
    own = [f"`{c}`" for c in df.columns]
    schema = widened(df, StructField(added, ArrayType(_ENTITY)))
    rest = possible.join(unsent(given), doc, "left").select(*own, given_name)
    at = df.columns.index(text)

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts, lists = [], []
                for value, entities_of in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    out, last, size, spans = [], 0, 0, []
                    for e in entities_of or []:
                        new = formatted(e["kind"], e["written"], e["surrogate"])
                        out += [value[last : e["start"]], new]
                        size += e["start"] - last
                        spans.append({"start": size, "end": size + len(new), "kind": e["kind"], "surrogate": new})
                        size += len(new)
                        last = e["end"]
                    texts.append(value if value is None else "".join(out) + value[last:])
                    lists.append(spans)
                columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(part.columns[:-1])]
                types = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, types)], schema.names)

    none = F.array().cast(ArrayType(_ENTITY))
    return clear.select(*own, none.alias(added)).unionByName(rest.mapInArrow(replace, schema))
