"""PII surrogates: each detected entity is replaced by another of its type, the same everywhere.

Detection is local to a text. An entity's normal form (lower-cased address, bare digits) with a
secret key gives its surrogate by HMAC, in the entity's own format: digits for digits, the same
punctuation, valid check digits, a name of the same gender and script. So mentions of one entity
share a surrogate wherever they stand. Given names and surnames are entities of their own, so that
"Hans Weber", "Mr Weber" and "Weber" stay one person. The distinct entities of all texts are then checked together:
where two would share a surrogate, or one would equal a real entity, all but one draw again, until
none collides. No kind runs out of surrogates: where an entity's format leaves few (a local part of
one letter), later draws are longer. Only entities that drew again have to be told to the rewriting pass: by broadcast if
they are few (checked), else by a join with the documents that mention them.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import columns_free_of, few_enough, numbered, small_batches, staged

#: Common given names by script and gender; fixed values.
FIRST = {
    ("latin", "f"): "Maria Anna Emma Sofia Laura Julia Sarah Lena Clara Elena Marta Alice Nina Paula Eva Louise Camille Carmen Lucia Ingrid Helen Ruth Grace Mary Patricia Jennifer Linda Susan Karen Emily".split(),
    ("latin", "m"): "Peter Paul Thomas Lukas Max Felix Jonas David Daniel Martin Carlos Miguel Pablo Jorge Pierre Louis Henri Antoine Hans Karl James John Robert Michael William Richard George Edward Frank Oliver".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Андрей Михаил Николай Павел Олег".split(),
}
#: Titles before a surname, with the gender they tell.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f"}
_GENDER = {name: (script, gender) for (script, gender), names in FIRST.items() for name in names}
#: Draws from which numbers leave their range, and twice as many from which they have more digits.
WIDER = 8
#: Drawn for a secret without letters and digits, as a mask is.
_MARKS = "!#$%&*+-.:=?@^_~"
#: Words after which a person's name stands, in lower case; fixed values.
CUES = ("my name is", "name is", "name:", "named", "signed,", "signed by", "regards,", "contact:", "contact person:", "dear", "attn:", "ich heiße", "mein name ist", "je m'appelle", "me llamo", "mi nombre es", "меня зовут")
#: Onsets, vowels and ends of made-up surnames.
SYLLABLES = {
    "latin": ("b br d dr f g gr h k kl l m n p r s st t v w".split(), "a e i o u".split(), "l ck nd rt ng ms rn ff lt sk".split()),
    "cyrillic": ("б бр в г гр д з к кл л м н п пр р с ст т".split(), "а е и о у".split(), "лов ров ков нов дин тин рин сев гов бин".split()),
}
_NAME = r"[^\W\d_a-zà-öø-ÿа-яё](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_BEFORE_NAME = re.compile(
    rf"\b(?P<title>{'|'.join(TITLES)})\.?\ (?:(?P<given>{_NAME})\ )?(?P<surname>{_NAME})"
    rf"|\b(?i:{'|'.join(map(re.escape, CUES))})\s+(?P<given2>{_NAME})(?:\ (?P<surname2>{_NAME}))?"
    rf"|\b(?P<given3>{'|'.join(_GENDER)})\ (?P<surname3>{_NAME})"
)
#: Capitalised words after a cue or a given name that are no person's.
NO_NAMES = frozenset(
    "The A An This That These Those My Your Our Their All Everyone Everybody Anyone Sir Madam Sirs Customer Customers Client Clients User Users Team Teams Friend Friends Colleague Colleagues Reader Readers Member Members Guest Guests Parent Parents "
    "Student Students Editor Editors Manager Support Staff Department Office Service Services Sales Company Group Committee Board Admin Administrator Owner Id Ids Name Names File Files Readme Index Table Column Key Value Null None Unknown Test Example "
    "Entity Entities Recognition Pipe Parameter Parameters Argument Arguments Variable Variables Function Query Server Host Domain Project Module Package Class Type Version "
    "Street Road Avenue Lane Square Bridge River Lake Mountain Valley County City Town Island Park Garden Gardens Hill Bay Beach Cathedral Church Chapel Temple Abbey Castle Palace Tower Hall House Hotel Hospital School College University Institute Academy Library Museum Theatre "
    "Theater Stadium Airport Station Center Centre Bank Foundation Society Association Corporation Inc Ltd Press Times Journal Award Prize Cup Day Week Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December".split()
)
#: Endings of surnames, and lower-case words beside a person's name; two signs of them or of neighbours make a capitalised pair a name.
_SURNAME_END = re.compile("(?:sk[iay]|cki|wicz|czyk|sen|sson|son|ez|ovic|ović|ova|eva|ov|ev|mann|berg|stein|feld|bauer|meier|escu|idis|opoulos|yan|ian|enko|chuk|ini|elli|etti)$")
_PERSONAL_AFTER = frozenset("said says met meets wrote writes lives lived works worked called calls told asked born joined and has is was phoned emailed signed thinks knows".split())
_PERSONAL_BEFORE = frozenset("met with by and from called told asked named to said contact colleague friend wife husband daughter son brother sister neighbour neighbor patient".split())
_PAIR = re.compile(r"(?<![\w'’-])([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{2,}) ([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{2,})(?![\w'’-])")
_KNOWN, _WORD = frozenset([*TITLES, *_GENDER]), re.compile(r"[A-ZÀ-ÖØ-ÞЀ-Я][^\W\d_]+")
#: A word of every cue.
_CUE_SIGNS = ("name", "signed", "regards", "contact", "dear", "attn", "heiße", "appelle", "llamo", "nombre", "зовут")
_FEMININE = re.compile("(?:ов|ев|ин)а$")


def _script(name: str) -> str:
    return "cyrillic" if re.search("[А-яЁё]", name) else "latin"


def _surname_form(mention: str) -> str:
    """A surname's normal form: lower case, a feminine end of Russian names taken off."""
    low = mention.lower()
    return low[:-1] if _FEMININE.search(low) else low


def names(text: str, low: str) -> list[tuple[int, int, str, str]]:
    """Given names and surnames after a title, a cue or a known given name, pairs that two signs tell, and further mentions of the surnames in the text."""
    found: dict[tuple[int, int], str] = {}
    for m in _PAIR.finditer(text):
        given, surname = m.groups()
        start, end = m.span()
        before = text[max(start - 16, 0) : start].rpartition(" ")[0].rpartition(" ")[2] if text[start - 1 : start] == " " else ""
        after = text[end + 1 : end + 16].partition(" ")[0].rstrip(".,;:!?") if text[end : end + 1] == " " else ""
        if given in NO_NAMES or surname in NO_NAMES or given in TITLES or before in ("the", "a", "an"):
            continue
        signs = (given in _GENDER) + (_SURNAME_END.search(surname) is not None) + (after in _PERSONAL_AFTER) + (before in _PERSONAL_BEFORE)
        if signs >= 2:
            found[m.span(1)], found[m.span(2)] = "given", "surname"
    if not found and _KNOWN.isdisjoint(_WORD.findall(text)) and not any(x in low for x in _CUE_SIGNS):
        return []
    for m in _BEFORE_NAME.finditer(text):
        title = m["title"] and m["surname"] in TITLES
        some = [m[g] for g in ("given", "surname", "given2", "surname2", "given3", "surname3") if m[g]]
        if not NO_NAMES.isdisjoint(some) or m["given3"] and text[max(m.start() - 4, 0) : m.start()].lower().endswith("the "):
            continue
        for group in () if title else ("given", "surname", "given2", "surname2", "given3", "surname3"):
            if m[group] and m[group] not in TITLES:
                found[m.span(group)] = group.rstrip("23")
    if not found:
        return []
    surnames = {text[a:b] for (a, b), kind in found.items() if kind == "surname"}
    surnames |= {s.upper() for s in surnames}
    if surnames:
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(surnames, key=len, reverse=True)))})\b", text):
            found.setdefault(m.span(), "surname")
    return [(a, b, kind, _surname_form(text[a:b]) if kind == "surname" else text[a:b].lower()) for (a, b), kind in found.items()]


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(reversed(values))) % 10 == 0


def _bare(mention: str) -> str:
    return re.sub(r"\D", "", mention)


def _same(mention: str) -> str:
    return mention


class Stream:
    """Keyed choices for one entity and draw; ``draw`` tells how far a surrogate has to grow."""

    def __init__(self, key: bytes, kind: str, entity: str, draw: int):
        self.draw = draw
        self.seed, self.count, self.data = (key, f"{kind}\0{entity}\0{draw}".encode("utf-8", "surrogatepass")), 0, b""

    def below(self, n: int) -> int:
        while len(self.data) < 8:
            self.data += hmac.digest(self.seed[0], self.seed[1] + self.count.to_bytes(4, "big"), "sha256")
            self.count += 1
        value, self.data = int.from_bytes(self.data[:8], "big"), self.data[8:]
        return value % n

    def pick(self, options: str | list[str]) -> str:
        return options[self.below(len(options))]


def shaped(s: Stream, text: str, digits: str = "0123456789") -> str:
    """Hexadecimal stays so; else letters for letters of their case, digits for digits, all else as it is."""
    if len(text) >= 16 and re.fullmatch(r"(?=.*\d)(?=.*[a-f])[0-9a-f]+", text):
        return "".join(s.pick("0123456789abcdef") for _ in text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return "".join(s.pick(digits) if c.isdigit() else s.pick(upper) if c.isupper() else s.pick(lower) if c.isalpha() else c for c in text)


def _email(s: Stream, entity: str) -> str:
    local, _, domain = entity.rpartition("@")
    labels = domain.split(".")
    tail = labels[-1] if labels[-1] in ("com", "net", "org") else "com"
    # a longer label with every draw, so that short local parts never run out
    own = ["".join(s.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(min(s.draw, 60)))] if s.draw else []
    return shaped(s, local) + "@" + ".".join([*[shaped(s, x) for x in labels[:-2]], *own, "example", tail])


def _secret(s: Stream, entity: str) -> str:
    own = shaped(s, entity) if any(c.isalpha() or c.isdigit() for c in entity) else "".join(s.pick(_MARKS) for _ in entity)
    return own + "".join(s.pick("abcdef0123456789") for _ in range(s.draw))


def _more(s: Stream) -> str:
    return "".join(s.pick("0123456789") for _ in range(s.draw - 2 * WIDER + 1))


def _phone(s: Stream, entity: str) -> str:
    if entity[0] == "+":
        return _dialled(s, entity)
    country, rest = entity[:-10], entity[-10:]
    middle = "555" if rest[3:6] == "555" and s.draw < WIDER else s.pick("23456789") + s.pick("0123456789") + s.pick("0123456789")
    return country + s.pick("23456789") + s.pick("0123456789") + s.pick("0123456789") + middle + "".join(s.pick("0123456789") for _ in rest[6:]) + _more(s)


def _dialled(s: Stream, entity: str) -> str:
    return entity[1:3] + "".join(s.pick("0123456789") for _ in entity[3:]) + _more(s)


def _card(s: Stream, entity: str) -> str:
    """The issuer's first two digits stay, and with them the length that goes with them."""
    body = entity[:2] + "".join(s.pick("0123456789") for _ in entity[2:-1]) + _more(s)
    return body + (next(d for d in "0123456789" if luhn(body + d)) if luhn(entity) else s.pick("0123456789"))


def _ssn(s: Stream, entity: str) -> str:
    return "".join(s.pick("0123456789") for _ in entity) + _more(s)


def _ip(s: Stream, entity: str) -> str:
    first = entity.split(".")[0]
    if s.draw >= 2 * WIDER:  # no address any more
        return ".".join(str(256 + s.below(744)) for _ in range(4))
    head = first if first in ("10", "127", "192", "172") and s.draw < WIDER else str(11 + s.below(115))
    return ".".join([head, *[str(s.below(256)) for _ in range(2)], str(1 + s.below(254))])


def _iban(s: Stream, entity: str) -> str:
    body = shaped(s, entity[4:]) + _more(s)
    number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
    return f"{entity[:2]}{98 - number % 97:02d}{body}"


def _access_key(s: Stream, entity: str) -> str:
    return entity[:4] + "".join(s.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in entity[4:])


def _surname(s: Stream, entity: str) -> str:
    """A made-up surname of the entity's script, longer with every draw, so that surnames never run out."""
    onsets, vowels, ends = SYLLABLES[_script(entity)]
    return "".join(s.pick(onsets) + s.pick(vowels) for _ in range(1 + s.draw)) + s.pick(onsets) + s.pick(vowels) + s.pick(ends)


def _given(s: Stream, entity: str) -> str:
    """A given name of the same gender and script, more of them with every draw. An unknown one's gender is read off its end."""
    known = _GENDER.get(entity.capitalize()) or (_script(entity), "f" if entity[-1] in "aeая" else "m")
    return "-".join(s.pick(FIRST[known]).lower() for _ in range(1 + s.draw))


@dataclass(frozen=True)
class Kind:
    """A type of entity: its pattern (group 1 if it has one), normal form, surrogate of a normal form, and test."""

    name: str
    pattern: re.Pattern
    normal: Callable[[str], str]
    surrogate: Callable[[Stream, str], str]
    accept: Callable[[str], bool] = bool
    #: Looked for first, as most texts hold none: one of these in the lower-case text, or this pattern.
    signs: tuple[str, ...] = ()
    sign: re.Pattern | None = None
    digits_only: bool = False

    def may_stand_in(self, text: str, low: str) -> bool:
        return any(x in low for x in self.signs) if self.sign is None else self.sign.search(text) is not None


#: Seven digits and separators, as every number below has; two digits and 11 more characters of an IBAN.
_NUMBER = re.compile(r"\d[\d .()+-]{5,}\d")
_LONG = re.compile(r"\d\d[A-Z0-9]{11}")


def _iban_valid(text: str) -> bool:
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


#: In order of precedence where matches overlap.
KINDS = (
    Kind("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"), str.lower, _email, signs=("@",)),
    Kind("access_key", re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"), _same, _access_key, signs=("akia", "asia")),
    Kind("password", re.compile(r"(?i)\b(?:password|passwd|pwd|secret)\s?[=:]\s?[\"']?([^\s\"']{6,})"), _same, _secret, signs=("password", "passwd", "pwd", "secret")),
    Kind("token", re.compile(r"(?i)\b(?:token|api[_-]?key|access[_-]?token|bearer)\s?[=:]?\s?[\"']([^\s\"']{12,})[\"']"), _same, _secret, signs=("token", "api", "bearer")),
    Kind("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Z0-9])"), _same, _iban, _iban_valid, sign=_LONG),
    Kind("card", re.compile(r"(?<![\d.-])(?:[3-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])"), _bare, _card, lambda m: luhn(_bare(m)), sign=_NUMBER, digits_only=True),
    Kind("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)\s?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"), _bare, _phone, sign=_NUMBER, digits_only=True),
    Kind("phone", re.compile(r"(?<![\w.+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]\d{2,8}){2,4}(?![\d-])"), lambda m: "+" + _bare(m), _phone, lambda m: 8 <= len(_bare(m)) <= 15, sign=_NUMBER, digits_only=True),
    Kind("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _bare, _ssn, sign=_NUMBER, digits_only=True),
    Kind("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)(?!\w)"), _same, _ip, lambda m: all(int(x) < 256 for x in m.split(".")), sign=_NUMBER),
    Kind("given", re.compile("(?!)"), str.lower, _given),  # found by names()
    Kind("surname", re.compile("(?!)"), _surname_form, _surname),
)
_BY_NAME = {k.name: k for k in reversed(KINDS)}


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of a text's entities, left to right, none overlapping."""
    if not text:
        return []
    low, found = text.lower(), []
    checked: dict[re.Pattern | None, bool] = {}
    for kind in KINDS:
        if kind.sign not in checked or kind.sign is None:
            checked[kind.sign] = kind.may_stand_in(text, low)
        if not checked[kind.sign]:
            continue
        for m in kind.pattern.finditer(text):
            start, end = m.span(m.re.groups and 1)
            if kind.accept(text[start:end]) and not any(start < b and a < end for a, b, _, _ in found):
                found.append((start, end, kind.name, kind.normal(text[start:end])))
    found += [n for n in names(text, low) if not any(n[0] < b and a < n[1] for a, b, _, _ in found)]
    return sorted(found)


def pooled(entity: str) -> str:
    """A normal form as surrogates are written: a dialled number without its sign."""
    return entity.removeprefix("+")


def surrogate(key: bytes, kind: str, entity: str, draw: int = 0) -> str:
    """Surrogate normal form of an entity's normal form; never the entity itself."""
    for again in range(100):
        s = Stream(key, kind, entity, draw + again * 1_000_000)  # of a sequence that no collision reaches
        s.draw = draw + again
        found = _BY_NAME[kind].surrogate(s, entity)
        if found != pooled(entity):
            return found
    raise ValueError(f"no surrogate for an entity of kind {kind}")


def in_format(kind: str, mention: str, found: str) -> str:
    """A surrogate's normal form written as the mention is."""
    if _BY_NAME[kind].digits_only:
        digits = iter(found.removeprefix("+"))
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "surname" and _FEMININE.search(mention.lower()):
        found += "а"
    if kind in ("given", "surname") and not mention.isupper():
        return found.title()
    return found.upper() if kind in ("email", "given", "surname") and mention.isupper() else found


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds, names = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for kind, name in {(k, n) for _, _, k, n in detect(text)}:
                ids.append(i)
                kinds.append(kind)
                names.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(names, pa.string())], names=["id", "kind", "entity"])


def _draws(key: bytes) -> Callable:
    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, e, int(d)) for k, e, d in zip(kind, entity, n, strict=True)], dtype=object)

    return draw


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, draw, surrogate) for distinct (kind, entity): no two surrogates of a kind equal, none a real entity."""
    draw = _draws(key)
    bare = F.when(F.col("kind") == "phone", F.regexp_replace("entity", r"^\+", "")).otherwise(F.col("entity"))
    real = entities.select("kind", bare.alias("surrogate")).distinct()
    settled: DataFrame | None = None
    todo = entities.withColumn("draw", F.lit(0))
    while True:
        drawn = staged(todo.withColumn("surrogate", draw("kind", "entity", "draw")), "drawn")
        # one of those with equal surrogates keeps it: the one of the smallest entity
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        first = first.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            first = first.join(settled, ["kind", "surrogate"], "left_anti")
        kept = drawn.join(first, ["kind", "surrogate", "entity"], "left_semi")
        settled = staged(kept if settled is None else settled.unionByName(kept), "settled")
        left = drawn.join(settled, ["kind", "entity"], "left_anti")
        if few_enough(left, 0):
            return settled
        todo = left.select("kind", "entity", (F.col("draw") + 1).alias("draw"))


def _rewrite(key: bytes, text: Column, redrawn: Column, few: dict | None, spark) -> Column:
    shared = spark.sparkContext.broadcast((key, few or {}))

    @F.pandas_udf("text string, entities array<struct<start:int,end:int,kind:string,surrogate:string>>")
    def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        key, few = shared.value
        for texts, redrawn in parts:
            out = []
            for t, own in zip(texts, redrawn, strict=True):
                draws = few if own is None else {(r["kind"], r["entity"]): r["draw"] for r in own}
                pieces, found, at, shift = [], [], 0, 0
                for start, end, kind, entity in detect(t):
                    new = in_format(kind, t[start:end], surrogate(key, kind, entity, draws.get((kind, entity), 0)))
                    pieces += [t[at:start], new]
                    found.append({"start": start + shift, "end": start + shift + len(new), "kind": kind, "surrogate": new})
                    at, shift = end, shift + len(new) - (end - start)
                out.append(("".join([*pieces, t[at:]]) if pieces else t, found))
            yield pd.DataFrame({"text": pd.Series([x for x, _ in out], dtype=object), "entities": pd.Series([x for _, x in out], dtype=object)})

    return rewrite(text, redrawn)


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", few_redrawn: int = 100_000) -> DataFrame:
    """docs with rewritten texts and a column ``entities`` (places in the new text, kind, surrogate).

    A null text stays null and has no entities; texts without entities are not changed. Rows of equal
    or null ids are rewritten each by its own text. docs' own column of that name is replaced; all others
    stay, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = staged(texts.mapInArrow(_entities, "id long, kind string, entity string"), "mentions")
    assigned = assign(found.select("kind", "entity").distinct(), key)
    redrawn = assigned.where("draw > 0").select("kind", "entity", "draw")
    kept = [c for c in docs.columns if c.lower() != "entities"]
    own, done, key_id, row_id = columns_free_of(docs, "_redrawn", "_done", "_id", "_row")
    if few_enough(redrawn, few_redrawn):
        few = {(r.kind, r.entity): r.draw for r in redrawn.collect()}
        rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("array<struct<kind:string,entity:string,draw:int>>").alias(own))
    else:
        few = None
        # by row, whatever its id: no list holds more than one text's entities
        texts = numbered(docs.select(*[F.col(f"`{c}`") for c in kept]), key_id, "rows")
        mentions = texts.select(F.col(key_id).alias("id"), F.col(text_col).alias("text")).mapInArrow(_entities, "id long, kind string, entity string")
        per = mentions.join(redrawn, ["kind", "entity"]).groupBy(F.col("id").alias(row_id)).agg(F.collect_set(F.struct("kind", "entity", "draw")).alias(own))
        rows = texts.join(per, F.col(key_id) == F.col(row_id), "left").drop(key_id, row_id)
    rows = rows.withColumn(done, _rewrite(key, F.col(text_col), F.col(own), few, spark))
    columns = [F.col(f"{done}.text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in kept]
    return rows.select(*columns, F.col(f"{done}.entities").alias("entities"))
