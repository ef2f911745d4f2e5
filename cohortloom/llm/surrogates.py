"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found by pattern. The free characters of one (digits, letters, address
parts) are read as a number and sent through a keyed permutation of all numbers of that
format, so one entity always gets the same surrogate and two never share one, in any
document, without a table of what has been given out. Country codes, issuer digits, top
level domains, separators, letter case, script and a card's right check digit all stay.

A person is known by a title. Given names (by gender) and family names have surrogates of
their own, made of syllables of their script, so "Mrs Anna Smith", "Mrs Smith" and a later
"Anna" still tell of one person; a name that a title has shown is replaced wherever it
stands in the text. Where a hashed name meets another's, or a surrogate equals some real
entity, a check over all entities gives those concerned another try until none is left.

Null texts stay null and have no entities. Repeated rows get equal results. Texts of any
length are read whole; empty tables give empty results. Which of several entities keeps a
surrogate that they share is settled by the smaller value. Extra columns stay as they are;
``out_col`` must not be one of them.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, has_rows, save

# Titles by gender, in Latin and Cyrillic letters.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Srta", "Госпожа", "госпожа", "Г-жа", "г-жа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "господин", "Г-н", "г-н")
# What surrogate names are made of, by script: beginnings, vowels and ends of
# syllables, and how names of each kind end.
SYLLABLES = {
    "latin": ("b br c d dr f g gr h j k l m n p r s st t v".split(), "a e i o u".split(), ["", "l", "n", "r", "s"]),
    "cyrillic": ("б бр в г гр д др ж з к л м н п р с ст т ф х".split(), "а е и о у".split(), ["", "л", "н", "р", "с"]),
}
ENDINGS = {
    "latin": {
        "female": "a ia ina ela isa ona ette elle ea ira ava ine".split(),
        "male": "o us an er on ic ard ert in or ek im".split(),
        "family": "son man ell er es ini ov ard ley ton berg ez".split(),
    },
    "cyrillic": {
        "female": "а ия ина ела иса она ета ея ира ава яна ида".split(),
        "male": "ан ей ий ор ил им он ар ит ур ен ад".split(),
        "family": "ко ук ян дзе ич их ман ер оль ас ей инь".split(),
    },
}

LATIN = "àáâäãåèéêëìíîïòóôöõùúûüñçýÿ"
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", LATIN, LATIN[:-1].upper())
HEX = ("0123456789abcdef", "0123456789ABCDEF")
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}

TITLES = "|".join(sorted(FEMALE_TITLES + MALE_TITLES, key=len, reverse=True))
UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'-]+"
SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
PHONE = r"(?P<phone>(?<![\w.])(?:\+|00)\d{2}[ .-]\d{1,2}(?:[ .-]\d{2}){4}(?![\w]|\.\d)|(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w]|\.\d)|(?<!\w)\+\d{8,15}\b)"
PATTERNS = re.compile(
    r"(?P<email>[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>\b(?i:token|secret|password|passwd|api[_-]?key)\b[ \t]*[=:][ \t]*[\"']?(?P<value>[A-Za-z0-9_\-]{16,})"
    r"|\b(?:AKIA[A-Z0-9]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{30,})\b)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    rf"|{SSN}"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<card>(?<![\w.])(?!00\d{2}[ .-]\d{1,2}(?:[ .-]\d{2}){4}(?!\w|\.\d))\d(?:[ -]?\d){12,18}(?![\w]|\.\d))"
    rf"|{PHONE}"
    rf"|\b(?P<title>{TITLES})\.? (?P<name>{UPPER}(?: {UPPER})?)"
)
#: What else may begin where a run of digits does.
NUMBERS = re.compile(f"{SSN}|{PHONE}")
#: Digits and single separators, of which a card may be a part.
RUN = re.compile(r"\d+(?:[ -]\d+)*")
#: Groups of digits as cards are written in; and numbers that are complete beside others.
LAYOUT = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,4}|\d{4}[ -]\d{6}[ -]\d{4,5}")
COMPLETE = re.compile(r"(?<![\w.])(?:\d{3}([ .-])\d{3}\1\d{4}|\d{3}-\d{2}-\d{4})(?![\w]|\.\d)")
#: A line without any of these has no entity.
HINTS = (re.compile("[0-9@=:]"), re.compile(rf"(?:{TITLES})\.? "), re.compile("AKIA|sk-|ghp_"))
#: Tries in its own format, before a name or an address gets more letters; and tries in all.
OWN_TRIES, TRIES = 12, 60


def hinted_lines(text: str) -> Iterator[tuple[int, int]]:
    """Where the lines that may hold an entity start and end; no pattern crosses lines."""
    at = 0
    nearest = [h.search(text) for h in HINTS]
    while any(nearest):
        first = min(m.start() for m in nearest if m)
        start, end = text.rfind("\n", 0, first) + 1, text.find("\n", first)
        at = end if end >= 0 else len(text)
        yield start, at
        nearest = [m and (m if m.start() >= at else h.search(text, at)) for m, h in zip(nearest, HINTS)]


def entities(text: str) -> list[tuple[str, int, int, str]]:
    """(type, start, end, key): the key is what coreferent mentions share.

    A run of 13 to 19 digits is a card only if its check digit is right. Numbers beside an
    entity may stand in one run with it: see ``card_in`` and ``is_part``.
    """
    out, named = [], []
    for line_start, line_end in hinted_lines(text):
        at, run_end = line_start, line_start
        while m := PATTERNS.search(text, at, line_end):
            kind = m.lastgroup
            if m["name"]:
                named.append(m)
                at = m.end()
                continue
            part = "value" if m["value"] else 0
            start, end, found = m.start(part), m.end(part), m[part]
            at = m.end()
            if kind == "card":
                span = card_in(text, start, end, line_end, start < run_end)
                if not span:
                    # Other entities may begin at any group of the run.
                    run_end = max(run_end, RUN.match(text, start, line_end).end())
                    m = NUMBERS.match(text, start, line_end)
                    if not m or is_part(text, m, line_end, True):
                        at = start + len(re.match(r"\d+", found)[0])
                        continue
                    kind, start, end, found, at = m.lastgroup, m.start(), m.end(), m[0], m.end()
                elif span[0] > start:
                    out += entities_before(text, start, span[0])
                if span:
                    start, end = span
                    found, at = text[start:end], end
            elif kind == "phone" and is_part(text, m, line_end, start < run_end):
                at = start + max(1, len(re.match(r"\d*", found)[0]))
                continue
            key = found
            if kind == "email":
                key = found.lower()
            elif kind == "phone":
                code = re.match(r"\+\d{1,3}(?=[ .(-])|00\d{2}(?=[ .-]\d{1,2}[ .-])", found)
                key = (code[0] if code else "") + "/" + re.sub(r"\D", "", found[code.end() if code else 0 :])
            elif kind in ("card", "iban", "ssn"):
                key = re.sub(r"[ -]", "", found)
            elif kind == "value":
                kind = "secret"
            out.append((kind, start, end, key))
    return sorted(out + mentions_of(text, named, out), key=lambda e: e[1]) if named else out


def mentions_of(text: str, named: list[re.Match], others: list[tuple]) -> list[tuple[str, int, int, str]]:
    """The names of persons, part by part: given names by gender, and family names.

    ``named`` are mentions with a title. What they call a given or a family name is found
    wherever else it stands in the text, with another title, alone or in part.
    """
    role: dict[str, str] = {}
    for m in named:
        words = m["name"].split(" ")
        gender = "female" if m["title"] in FEMALE_TITLES else "male"
        for kind, word in zip([gender, "family"][-len(words) :], words):
            if kind != "family" or word.lower() not in role:
                role[word.lower()] = kind
    own = {}
    for m in named:
        gender, at = "female" if m["title"] in FEMALE_TITLES else "male", m.start("name")
        for word in m["name"].split(" "):
            kind = role[word.lower()]
            own[at] = (gender if kind != "family" else kind, at, at + len(word), word.lower())
            at += len(word) + 1
    taken = [(a, b) for _, a, b, _ in others]
    every = re.compile("|".join(sorted({re.escape(m_) for m in named for m_ in m["name"].split(" ")}, key=len, reverse=True)), re.IGNORECASE)
    for m in every.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before.isalnum() or after.isalnum() or not m[0][0].isupper() or m.start() in own:
            continue
        if not any(a < m.end() and m.start() < b for a, b in taken):
            own[m.start()] = (role[m[0].lower()], m.start(), m.end(), m[0].lower())
    return list(own.values())


def entities_before(text: str, start: int, end: int) -> list[tuple[str, int, int, str]]:
    """The entities of the numbers that stand before a card in one run."""
    return [(k, a + start, b + start, v) for k, a, b, v in entities(text[start:end])]


def card_in(text: str, start: int, end: int, line_end: int, rest: bool) -> tuple[int, int] | None:
    """Where a card lies in the run of digits that was matched from ``start`` to ``end``.

    Of whole groups, those with a right check digit: first what is laid out as cards are,
    by one kind of separator and beginning as most cards do, then the longest that begins
    where the run does, unless ``start`` is in the ``rest`` of a run that was read before.
    """
    groups = [m.span() for m in re.finditer(r"\d+", text[start : RUN.match(text, start, min(line_end, end + 40)).end()])]
    best = None
    for i, (a, _) in enumerate(groups):
        if start + a >= end:
            break
        digits = ""
        for x, b in groups[i:]:
            digits += text[start + x : start + b]
            if len(digits) > 19:
                break
            if len(digits) < 13 or luhn(digits[:-1]) != int(digits[-1]):
                continue
            if text[start + b : start + b + 1].isalnum() or re.match(r"\.\d|\w", text[start + b : start + b + 2]):
                continue
            found = text[start + a : start + b]
            mixed, usual = " " in found and "-" in found, bool(LAYOUT.fullmatch(found))
            if usual or i == 0 and not (mixed or rest or COMPLETE.search(found)):
                rank = (not usual, mixed, found[0] not in "3456", a, -b)
                best = min(best, (rank, a, b)) if best else (rank, a, b)
    return best and (start + best[1], start + best[2])


def is_part(text: str, m: re.Match, line_end: int, in_run: bool) -> bool:
    """Whether what looks like a phone is made of parts of other numbers.

    It is where a complete number begins inside it and ends behind it. In a run that is no
    card it is as well where the same separator joins it to further digits, unless it has
    the groups of a complete number or begins with a zero or a sign.
    """
    found = m[0]
    if m.lastgroup != "phone" or not found[0].isdigit() or m.start() and text[m.start() - 1] == "+":
        return False
    other = COMPLETE.search(text, m.start() + 1, min(line_end, m.end() + 12))
    if other and other.start() < m.end() < other.end() and not COMPLETE.fullmatch(found):
        return True
    if not in_run or found[0] == "0" or COMPLETE.fullmatch(found):
        return False
    separators = set(re.sub(r"\d", "", found))
    before, after = re.search(r"\d([ -])$", text[max(0, m.start() - 2) : m.start()]), re.match(r"([ -])\d", text[m.end() : m.end() + 2])
    return any(x and x[1] in separators for x in (before, after))


def permuted(number: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): Feistel rounds, walked until inside the range."""
    if size <= 1:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    wide = (half + 7) // 8
    while True:
        a, b = number >> half, number & mask
        for r in range(8):
            f = hashlib.blake2b(f"{r}|{tweak}|{size}|{b}".encode(), digest_size=min(64, wide + 8), key=key).digest()
            a, b = b, (a ^ int.from_bytes(f, "big")) & mask
        number = a << half | b
        if number < size:
            return number


def spelled(text: str, key: bytes, tweak: str, alphabets: dict[str, str] = ALPHABET_OF) -> str:
    """``text`` with every character of an alphabet replaced by one of the same alphabet."""
    number, size = 0, 1
    for c in text:
        if c in alphabets:
            number = number * len(alphabets[c]) + alphabets[c].index(c)
            size *= len(alphabets[c])
    form = "".join(alphabets[c][0] if c in alphabets else c for c in text)
    number, out = permuted(number, size, key, tweak + form), []
    for c in reversed(text):
        if c in alphabets:
            number, d = divmod(number, len(alphabets[c]))
            c = alphabets[c][d]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def made_name(kind: str, value: str, key: bytes, tweak: str) -> str:
    """A name of three syllables and an ending that suits the kind, in the value's script:
    one of 1.5 billion, by a keyed hash."""
    script = "cyrillic" if any("а" <= c <= "я" or c == "ё" for c in value) else "latin"
    draw = int.from_bytes(hashlib.blake2b((tweak + value).encode(), digest_size=16, key=key).digest(), "big")
    (starts, vowels, ends), out = SYLLABLES[script], ""
    for _ in range(3):
        for letters in (starts, vowels, ends):
            draw, i = divmod(draw, len(letters))
            out += letters[i]
    return out + ENDINGS[script][kind][draw % 12]


@functools.lru_cache(maxsize=50_000)
def surrogate(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The canonical surrogate of a canonical value; ``laid_out`` gives it its format."""
    tweak = f"{kind}|{attempt}|"
    if attempt >= OWN_TRIES and kind == "email":
        value = "a" * (1 + (attempt - OWN_TRIES) // 4) + value  # its own format is full
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return spelled(local, key, tweak + "l") + "@" + spelled(host, key, tweak + "d") + "." + top
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, permuted(n, 1 << 32, key, tweak).to_bytes(4, "big")))
    if kind == "card":
        body = value[0] + spelled(value[1:-1], key, tweak + value[0])
        return body + str(luhn(body))
    if kind == "iban":
        return value[:2] + spelled(value[2:], key, tweak + value[:2])
    if kind == "phone":
        code, _, digits = value.partition("/")
        return code + "/" + spelled(digits, key, tweak + code)
    if kind == "secret" and any(set(value) <= set(h) for h in HEX):
        letters = next(h for h in HEX if set(value) <= set(h))
        return spelled(value, key, tweak, dict.fromkeys(letters, letters))
    if kind in ("female", "male", "family"):
        return made_name(kind, value, key, tweak)
    return spelled(value, key, tweak)


def laid_out(kind: str, found: str, made: str) -> str:
    """``made`` in the format of the mention ``found``: its separators and letter case."""
    if kind in ("phone", "card", "iban", "ssn"):
        if kind == "phone":
            code, _, made = made.partition("/")
            head, found = found[: len(code)], found[len(code) :]
        else:
            head, made = "", made.replace("-", "").replace(" ", "")
        letters = iter(made)
        return head + "".join(next(letters) if c.isalnum() else c for c in found)
    if kind in ("female", "male", "family"):
        return made.upper() if len(found) > 1 and found.isupper() else made[:1].upper() + made[1:]
    if kind == "email" and len(made) == len(found):
        return "".join(m.upper() if c.isupper() else m for c, m in zip(found, made))
    return made


FIELDS = "array<struct<type:string,start:int,stop:int,original:string,surrogate:string>>"


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
    out, listed, at = [], [], 0
    for kind, start, end, value in entities(text):
        made = laid_out(kind, text[start:end], surrogate(kind, value, key, attempts.get((kind, value), 0)))
        out += [text[at:start], made]
        at = end
        listed.append({"type": kind, "start": start, "stop": end, "original": value, "surrogate": made})
    return "".join([*out, text[at:]]), listed


def second_tries(docs: DataFrame, key: bytes, text_col: str, rounds: int = TRIES) -> DataFrame | None:
    """(type, value, attempt) of the entities whose first surrogate won't do, or None.

    Over the distinct entities of all documents: a surrogate that several share stays with
    the first of them, one that is an entity itself or its own original goes. It ends
    when none is left to go, and raises an error if ``rounds`` don't suffice.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, v) for t in batch.column(0).to_pylist() if t for k, _, _, v in entities(t)}
            yield pa.RecordBatch.from_pydict(
                {"type": pa.array([k for k, _ in found], pa.string()), "value": pa.array([v for _, v in found], pa.string())}
            )

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, tries = (batch.column(i).to_pylist() for i in range(3))
            new = [surrogate(k, v, key, a) for k, v, a in zip(kinds, values, tries)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["type", "value", "attempt", "made"])

    known = docs.select(text_col).mapInArrow(listed, "type string, value string").distinct()
    current = save(
        known.withColumn("attempt", F.lit(0)).mapInArrow(made, "type string, value string, attempt int, made string"),
        "entities",
    )
    for _ in range(rounds):
        same = Window.partitionBy("type", "made").orderBy("attempt", "value")
        real = current.select(F.col("type").alias("_t"), F.col("value").alias("_v"))
        judged = current.withColumn("_n", F.row_number().over(same)).join(
            real, (F.col("type") == F.col("_t")) & (F.col("made") == F.col("_v")), "left"
        )
        bad = (F.col("_n") > 1) | F.col("_v").isNotNull()
        if not has_rows(judged.where(bad)):
            break
        again = judged.select("type", "value", (F.col("attempt") + bad.cast("int")).alias("attempt"))
        following = save(again.mapInArrow(made, "type string, value string, attempt int, made string"), "entities")
        discard(current)
        current = following
    else:
        raise RuntimeError(f"entities still share surrogates after {rounds} rounds")
    tries = current.where("attempt > 0").select("type", "value", "attempt")
    return tries if has_rows(tries) else None


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text", out_col: str = "entities") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` rewritten, and ``out_col``."""
    hash_col, again_col = free_name(docs, "_h"), free_name(docs, "_again")
    tries = second_tries(docs, key, text_col)
    retried = tries is not None
    schema = docs.schema
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    where = schema.names.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("original", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            texts = batch.column(where).to_pylist()
            again = batch.column(len(schema)).to_pylist() if retried else [None] * len(texts)
            done = [
                (None, []) if t is None else replaced(t, key, {(x["type"], x["value"]): x["attempt"] for x in a or []})
                for t, a in zip(texts, again)
            ]
            columns = list(batch.columns[: len(schema)])
            columns[where] = pa.array([d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], kind)], names=[*schema.names, out_col])

    out = f"{', '.join(names)}, `{out_col}` {FIELDS}"
    if not retried:
        return docs.mapInArrow(rewrite, out)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (h, k, v)
                for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t
                for k, v in {(k, v) for k, _, _, v in entities(t)}
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (list(zip(*rows)) or [[], [], []])], names=["_h", "type", "value"])

    hashed = docs.withColumn(hash_col, F.md5(text_col))
    tried = (
        hashed.select(text_col, hash_col).mapInArrow(mentions, "_h string, type string, value string").distinct()
        .join(tries, ["type", "value"])
        .groupBy(F.col("_h").alias(hash_col)).agg(F.collect_list(F.struct("type", "value", "attempt")).alias(again_col))
    )
    return hashed.join(tried, hash_col, "left").select(*schema.names, again_col).mapInArrow(rewrite, out)
