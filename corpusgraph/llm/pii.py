"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

A surrogate is a function of key, kind and entity, so every mention of one
entity in the corpus gets the same one (coreference). A corpus-wide check finds
entities of one kind that would share a surrogate, or one that is a real entity
of the corpus; all but the first of them draw again until none is left
(distinctness). Only these exceptions are kept in a table.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import rows_of, stored
from corpusgraph.session import fits_broadcast

#: Most exceptions that travel to every task; more are joined to their documents.
BROADCAST_ROWS = 100_000
ROUNDS = 50

# Given names by script and gender, and titles by gender, for person mentions.
NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carla Charlotte Claire Clara Diana Elena Elizabeth Emily Emma Eva Hannah Helen Isabel Jane Jennifer Julia Karen Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Monica Natalie Nina Olivia Patricia Paula Rachel Rosa Ruth Sandra Sara Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Benjamin Carl Carlos Charles Christopher Daniel David Edward Eric Felix Francis Frank George Hans Henry Hugo Jack Jacob James John Joseph Juan Karl Kevin Lucas Luis Mark Martin Matthew Michael Oliver Oscar Patrick Paul Peter Philip Pierre Richard Robert Samuel Simon Stefan Stephen Steven Thomas Victor Walter William".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Вера".split(),
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Михаил Николай Пётр Павел Виктор Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη Δήμητρα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Πέτρος Παύλος Ανδρέας".split(),
}
FAMILY = {
    "latin": "Adler Arnold Baker Becker Bennett Berger Brooks Carter Collins Cooper Costa Dawson Duran Ellis Fischer Fletcher Foster Garner Graham Harper Hoffman Hughes Jensen Keller Lambert Larsen Mercer Moreau Navarro Norris Palmer Parker Porter Reyes Richter Rossi Sawyer Schmidt Silva Sutton Tanner Turner Vargas Weaver Weber Winter Wood Ziegler".split(),
    "cyrillic": "Орлов Волков Зайцев Соколов Лебедев Козлов Новиков Морозов Егоров Павлов".split(),
    "greek": "Παππάς Νικολάου Γεωργίου Δημητρίου Ιωάννου Αντωνίου Βασιλείου Οικονόμου".split(),
}
TITLES = {"Mr": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Sra": "f", "Dr": "", "Prof": ""}
GIVEN = {n: (script, gender) for (script, gender), names in NAMES.items() for n in names}

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "person")
_CAP = r"[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я][^\W\d_]+"
#: Each search starts at a rare character, so that plain prose is only skimmed.
MAIL_LEFT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_])?$")
MAIL_RIGHT = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
CHUNK = re.compile(r"[+(\d][\d\x20().+-]{4,}[\d]")
NUMBER = re.compile(
    r"(?P<card>(?<![\w.-])\d(?:[\x20-]?\d){12,18}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w.+])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{3,4}[\x20.-]?\d{3,4}(?![\w-]))"
)
PERSON = re.compile(rf"(?<!\w)({_CAP})\.?((?:\x20{_CAP})+)(?!\w)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def persons(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of capitalised words after a title, or from a given name on."""
    for m in PERSON.finditer(text):
        words = [(m.start(1), m[1]), *((m.start(2) + w.start(), w[0]) for w in re.finditer(r"\S+", m[2]))]
        for i, (start, word) in enumerate(words[:-1]):
            if i == 0 and word in TITLES:
                yield words[1][0], m.end(), "person"
                break
            if word in GIVEN and (i or m.end(1) + 1 == m.start(2) + 1):
                yield start, m.end(), "person"
                break


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the entities of a whole text, in order, none overlapping."""
    if not text:
        return []
    found = []
    at = text.find("@")
    while at >= 0:
        # A local part has 64 characters at most; one more shows where it starts.
        left, right = MAIL_LEFT.search(text, max(0, at - 64), at), MAIL_RIGHT.match(text, at)
        if left and right:
            found.append((left.start(), right.end(), "email"))
        at = text.find("@", at + 1)
    found += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if not text[m.start() - 1 : m.start()].isalnum()]
    for chunk in CHUNK.finditer(text):
        for m in NUMBER.finditer(text, chunk.start(), min(len(text), chunk.end() + 8)):
            kind = m.lastgroup
            if kind == "card":
                digits = re.sub(r"\D", "", m[0])
                # Sixteen digits without the check digit are set like a card's all the same.
                kind = "card" if luhn(digits) or len(digits) == 16 else "phone"
            found.append((m.start(), m.end(), kind))
    found += persons(text)
    out, last = [], 0
    for start, end, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), -x[1])):
        if start >= last:
            out.append((start, end, kind))
            last = end
    return out


def normal(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn", "phone", "iban"):
        return re.sub(r"[^A-Za-z0-9+]", "", value)
    return value


class Stream:
    """Keyed numbers for one entity: HMAC-SHA256 over kind, entity and attempt, extended as needed."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.block, self.pool = key, f"{kind}\0{entity}\0{attempt}".encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.seed + self.block.to_bytes(4, "big"), "sha256")
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value * n >> 32


def _like(c: str, draw: Stream) -> str:
    """A character of the same class: digit, or letter of the same case and script."""
    if c.isdigit():
        return str(draw.below(10))
    if "a" <= c <= "z":
        return chr(97 + draw.below(26))
    if "A" <= c <= "Z":
        return chr(65 + draw.below(26))
    return c


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def canonical(kind: str, entity: str, key: bytes, attempt: int) -> str:
    """The surrogate of a normal form: same kind, length, character classes, gender and script.

    From the second attempt on addresses and names may change length, so that there are enough of them.
    """
    draw = Stream(key, kind, entity, attempt)
    if kind == "email":
        local, domain = entity.split("@", 1)
        # The host keeps its shape and its last two labels' place under a reserved name.
        return "".join(_like(c, draw) for c in local) + "@" + "".join(_like(c, draw) for c in domain.split(".")[0]) + ".example.org"
    if kind == "ip":
        # Octets keep their number of digits, at the first attempt; short ones have too few surrogates.
        if attempt:
            return ".".join(str(1 + draw.below(255)) for _ in range(4))
        spans = {1: (1, 9), 2: (10, 90), 3: (100, 155)}
        return ".".join(str(low + draw.below(n)) for low, n in (spans[len(o)] for o in entity.split(".")))
    if kind == "card":
        body = entity[0] + "".join(str(draw.below(10)) for _ in entity[2:])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)) == luhn(entity))
    if kind == "ssn":
        return f"{900 + draw.below(100)}{draw.below(100):02}{draw.below(10000):04}"
    if kind == "phone":
        # A country code stays.
        keep = 0 if entity[0] != "+" else 2 if entity[1:2] in ("1", "7") else 3
        return entity[:keep] + "".join(_like(c, draw) if i or c == "0" else str(1 + draw.below(9)) for i, c in enumerate(entity[keep:]))
    if kind == "iban":
        return entity[:2] + "".join(_like(c, draw) for c in entity[2:])
    words = entity.split(" ")
    script = _script(words[0])
    _, gender = GIVEN.get(words[0], (script, ""))
    given = NAMES[script, gender] if gender else NAMES[script, "f"] + NAMES[script, "m"]
    out = []
    for i, w in enumerate(words):
        pool = given if i == 0 and (gender or len(words) > 1) else FAMILY[script]
        pick = pool[draw.below(len(pool))]
        # Beyond the lists a name goes on in syllables, so that there are always more names.
        if attempt or i == len(words) - 1:
            pick += "".join("aeiou"[draw.below(5)] + "lnrst"[draw.below(5)] for _ in range(1 + attempt // 8)) if script == "latin" else "".join(("ов", "ин", "ев")[draw.below(3)] if script == "cyrillic" else ("ιδης", "ου", "ακης")[draw.below(3)] for _ in range(1 + attempt // 8))
        out.append(pick.upper() if w.isupper() and len(w) > 1 else pick)
    return " ".join(out)


def shaped(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate in the mention's format: its separators, and its case for addresses."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(surrogate)
        return "".join(next(rest, c) if c.isalnum() or c == "+" else c for c in mention)
    if kind == "email" and mention.isupper():
        return surrogate.upper()
    return surrogate


def entities(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, entity``: the distinct entities of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_of(whole):
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    out += [(doc, k, e) for k, e in sorted({(k, normal(k, text[s:x])) for s, x, k in detect(text)})]
                if out:
                    doc, kind, entity = zip(*out)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "kind": list(kind), "entity": list(entity)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, entity string")


def exceptions(found: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """``kind, entity, attempt`` of the entities whose first surrogate another has, or is a real entity.

    Each round draws for the entities still open, keeps in place the least
    entity of those that share a surrogate with no settled one, and sends the
    others on. Every mention was aggregated away before the first round.
    """
    spark = found.sparkSession

    def drawn(df: DataFrame, attempt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind, entity = b.column("kind").to_pylist(), b.column("entity").to_pylist()
                yield pa.RecordBatch.from_pydict({"kind": kind, "entity": entity, "fake": [canonical(k, e, key, attempt) for k, e in zip(kind, entity)]} if kind else {"kind": pa.array([], pa.string()), "entity": pa.array([], pa.string()), "fake": pa.array([], pa.string())})

        return df.select("kind", "entity").mapInArrow(run, "kind string, entity string, fake string")

    real = stored(found.groupBy("kind", "entity").agg(F.lit(0).alias("attempt")), "entities")
    settled, todo, late = None, real, None
    for attempt in range(rounds):
        fresh = stored(drawn(todo, attempt), "drawn")
        taken = real.select("kind", F.col("entity").alias("fake"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "fake"))
        first = fresh.groupBy("kind", "fake").agg(F.min("entity").alias("entity")).join(taken, ["kind", "fake"], "left_anti")
        good = stored(first.select("kind", "entity", "fake", F.lit(attempt).alias("attempt")), "settled")
        settled = good if settled is None else settled.union(good)
        if attempt:
            late = good if late is None else late.union(good)
        todo = stored(fresh.join(good.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity"), "open")
        if todo.limit(1).count() == 0:
            empty = spark.createDataFrame([], "kind string, entity string, attempt int")
            return empty if late is None else late.select("kind", "entity", "attempt")
    raise RuntimeError(f"entities still share surrogates after {rounds} rounds")


def replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and where they stand in it."""
    if text is None:
        return None, []
    out, at, size, spans = [], 0, 0, []
    for start, end, kind in detect(text):
        mention = text[start:end]
        entity = normal(kind, mention)
        fake = shaped(kind, mention, canonical(kind, entity, key, attempts.get((kind, entity), 0)))
        out += [text[at:start], fake]
        size += start - at
        spans.append({"kind": kind, "start": start, "end": end, "new_start": size, "new_end": size + len(fake)})
        size += len(fake)
        at = end
    return "".join([*out, text[at:]]) if out else text, spans


def pseudonymise(docs: DataFrame, key: str = "corpus", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with surrogates in ``text`` and a new column ``pii`` (kind, old and new span of each entity).

    Kinds: email, IBAN, card, social security number, IP address, phone, and
    persons by title or given name. Whole texts are read; null stays null,
    empty stays empty, a text without entities is unchanged to the character.
    Equal entities get equal surrogates in all rows, different ones of a kind
    different ones. Rows without doc_id and repeated rows are replaced like any
    other; a column named ``pii`` is replaced, other columns pass through.
    """
    docs = docs.drop("pii")
    secret = key.encode()
    found = stored(entities(docs), "pii-entities")
    late = stored(exceptions(found, secret), "pii-exceptions")
    spans = "array<struct<kind:string,start:long,end:long,new_start:long,new_end:long>>"
    held = None
    if fits_broadcast(late, broadcast_rows):
        held = docs.sparkSession.sparkContext.broadcast({(r.kind, r.entity): r.attempt for r in late.collect()})
        rows = docs.withColumn("_late", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        mine = found.join(late, ["kind", "entity"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("_late"))
        rows = docs.join(mine, "doc_id", "left")

    @F.pandas_udf(f"struct<text:string,pii:{spans}>")
    def swap(texts: pd.Series, late: pd.Series) -> pd.DataFrame:
        out = [
            replaced(t, secret, held.value if held else {(x["kind"], x["entity"]): x["attempt"] for x in (own if own is not None else ())})
            for t, own in zip(texts, late, strict=True)
        ]
        return pd.DataFrame({"text": [t for t, _ in out], "pii": [p for _, p in out]})

    done = rows.withColumn("_new", swap("text", "_late"))
    return done.withColumn("text", F.col("_new.text")).withColumn("pii", F.col("_new.pii")).drop("_new", "_late")
