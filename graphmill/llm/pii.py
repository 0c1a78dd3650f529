"""Personal data in free text, found by bootstrapped contextual extraction.

A generous scan emits candidate mentions with an instance key (a name, an address of mail or of a house;
the shape of a number) and the lexical patterns around them (two words left, two words right, one of each). A few
seeds start the bootstrap: given names from a reference list, international phone shapes, numbers
named by the word for a document, addresses of mail and of houses in their usual forms. Spark then scores the graph
of patterns and instances until no belief moves any more: a pattern is worth the share of its distinct instances that are
believed, weighed by how many distinct ones back it; an instance is believed by its best patterns. So a
pattern that stands around many different names is trusted and finds names no list holds, while a phrase
that always holds the same product name has one instance and stays worth nothing.

A mention becomes a find where a trusted pattern stands around it, or where nothing stands around it and its instance
is believed. The form of a seeded number or address counts as much as one pattern that always holds such data, so it is
a find unless the patterns around it mostly hold other things. Looser forms of both kinds of address (the town first or
without a comma, other words for the signs of a mail address) have no such vote: only patterns accept them.

Finds are replaced by a placeholder of their type.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.session import cut, tidy

TYPES = ("person_name", "email", "phone", "id_number", "address")
#: Rounds end when no belief moves by more than this.
SETTLED = 0.05
#: What an instance hears from its best pattern, as a share of the pattern's score: else a pattern would talk itself into full belief.
DAMPING = 0.7
#: Patterns below this score pass on nothing.
HEARD = 0.2
#: A pattern or instance is trusted from this score on.
TRUST = 0.35
#: Up to so many given names go to the workers as they are; beyond, as a filter of fixed size, and its hits are joined with them.
MOST_NAMES = 50_000
FILTER_BITS = 1 << 23

# ---- fixed values: words that name documents and parts of addresses
ID_WORDS = (
    "passport|passeport|reisepass|pasaporte|driving licence|driver'?s? licen[cs]e|führerschein|permis de conduire|national id(?: card)?|identity card|id card|personalausweis|ausweis|carte d'identité|dni|nie|nif|"
    "national insurance(?: number)?|nino|social security(?: number)?|ssn|sozialversicherungsnummer|numéro de sécurité sociale|nir|tax id|tax number|steuer-?id|steuernummer|tin|vat id|ust-?id|personal number|personnummer|insurance number|versichertennummer"
)
STREET_WORDS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Court|Ct|Way|Place|Pl|Square|Sq|Boulevard|Blvd|Terrace|Crescent|Row|Hill|Park|Gardens?|Grove|Walk|Mews|Parade|Highway|Quay"
STREET_ENDINGS = "straße|strasse|str\\.|weg|allee|gasse|platz|ring|damm|ufer|steig|pfad|chaussee"
STREET_STARTS = "Calle|C/|Avenida|Avda\\.?|Av\\.|Paseo|Plaza|Camino|Carrera|Ronda|Via|Viale|Corso|Piazza|rue|Rue|avenue|Avenue|boulevard|Boulevard|impasse|Impasse|allée|Allée|chemin|Chemin|place|Place|quai|Quai|cours|Cours|route|Route|square|passage|Passage"

_UP = "A-ZÀ-ÖØ-ÞŠŽĆČŁŚŻ"
_TOWN = rf"[{_UP}][\w'’]+(?:[ -](?:[{_UP}][\w'’]+|am|an der|im|sur|de la|de|del|upon|in der))*(?:-[{_UP}]\w+)*"
_HOUSE = r"\d{1,4} ?[a-zA-Z]?\b(?:[-/]\d{1,4}[a-z]?)?"
_CODE = r"(?:[A-Z]{1,2}-)?\d{4,5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}"
_UNIT = r"(?:\d{1,2} ?[ºªo°]\.? ?[A-Za-z]{0,3}|(?:Apt|Flat|Unit|Suite|App|Apto|Piso|bât|Whg|Apartment|No)\.? ?\w{1,4})"
_STREET = (
    rf"(?:{_HOUSE},? (?:[{_UP}][\w'’.-]* ){{1,3}}(?:{STREET_WORDS})\b\.?"
    rf"|[{_UP}][\w-]*(?:{STREET_ENDINGS}) ?{_HOUSE}|(?:[{_UP}]\w+[ -]){{1,2}}(?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Ring) {_HOUSE}"
    rf"|(?:{STREET_STARTS}) ?(?:(?:de la|de los|de|del|du|des|la|le|las|los|l'|d') ?)*(?:[{_UP}][\w'’-]* ?){{1,3}},? (?:n[º°o]\.? ?)?{_HOUSE}"
    rf"|{_HOUSE},? ?(?:bis,? |ter,? )?(?:{STREET_STARTS}) (?:(?:de la|de l'|de|du|des|la|le|l'|d') ?)*(?:[{_UP}][\w'’-]* ?){{1,3}})"
)
ADDRESS = re.compile(rf"(?<![\w@#/])(?:{_UNIT}, ?)?{_STREET}(?:, ?{_UNIT})? ?(?:[,\n] ?|(?={_CODE}))(?:(?:{_CODE}),? {_TOWN}|{_TOWN}(?:,? (?:[A-Z]{{2}} )?(?:{_CODE}))?)")
EMAIL = re.compile(r"(?<![\w.+%@/-])[\w.+%'-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@/-]|:[\w/~])")
HIDDEN_EMAIL = re.compile(
    r"(?<![\w.+%@/-])[\w.+%-]+(?:(?: ?(?:\[ ?at ?\]|\( ?at ?\)|\{ ?at ?\}|<at>|&#64;|＠) ?| ?@ ?)[A-Za-z0-9-]+(?:(?: ?(?:\[ ?dot ?\]|\( ?dot ?\)|\{ ?dot ?\}) ?|\.| dot )[A-Za-z0-9-]+)*(?: ?(?:\[ ?dot ?\]|\( ?dot ?\)|\{ ?dot ?\}) ?|\.| dot )[A-Za-z]{2,}|(?: at | AT |_at_)[A-Za-z0-9-]+(?:(?: dot | DOT |_dot_|\.)[A-Za-z0-9-]+)*(?: dot | DOT |_dot_)[A-Za-z]{2,})(?![\w@:/])",
    re.I,
)
_WORDS = rf"[{_UP}][\w'’.-]*(?: (?:(?:de la|de los|del|de|du|des|la|le|der|dem|am|an der) )?[{_UP}][\w'’.-]*){{0,3}}"
_PLACE = rf"(?:{_HOUSE},? {_WORDS}|{_WORDS},? {_HOUSE})"
_JOIN = r"(?: ?[,\n/] ?| - | \(| (?:in|at|near|bei|zu|à|en) | )"
#: A street and a number with a town in any order; counts only where a trusted pattern accepts it.
LOOSE_ADDRESS = re.compile(rf"(?<![\w@#/.-])(?:{_UNIT}, ?)?(?:{_PLACE}(?:, ?{_UNIT})?{_JOIN}(?:(?:{_CODE}),? )?{_TOWN}(?:,? (?:{_CODE}))?|(?:(?:{_CODE}),? )?{_TOWN}(?:,? (?:{_CODE}))?{_JOIN}{_PLACE})(?![\w@])")
_AT = r"(?: ?[\[({<*_-] ?(?:at|ät|a|@|arobase|arroba) ?[\])}>*_-] ?| (?:at|ät|arobase|arroba) | ?@ ?)"
_DOT = r"(?: ?[\[({<*_-] ?(?:dot|punkt|point|punto|\.) ?[\])}>*_-] ?| (?:dot|punkt|point|punto) |\.)"
#: A mail address with other signs or words for @ and the dot; counts only where a trusted pattern accepts it.
LOOSE_EMAIL = re.compile(rf"(?<![\w.+%@/-])[\w.+%-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@:/(])", re.I)
NUMBER = re.compile(
    r"(?<![\w.+@#=&%/-])(?:\(?\+\d{1,3}\)?|\(\d{2,5}\)|\d{1,11}|[A-Z]{1,6} ?-?(?=\d))(?:[A-Z]{0,7}\d*)*(?:(?: ?[/.-] ?| )?\(?(?:\d[\dA-Z]*|[A-Z]{1,2}(?![\w]))\)?)*(?: ?(?:ext\.?|x|Durchwahl|poste|DW) ?\d{1,5})?(?![\w@])"
)
_SIMPLE_ID = re.compile(r"(?<![\w.@#=/-])(?=[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z][A-Z0-9]{6,14}(?![\w@])")
_GIVEN = rf"[{_UP}][a-zà-öø-ÿšžćčłśż]+(?:-[{_UP}][a-zà-öø-ÿ]+)?"
_FAMILY = rf"(?:(?:van der|van|von|de la|de|del|da|di|le|la|el|al|bin|ten|ter|O'|Mc|Mac) ?)?[{_UP}][\w'’]*[a-zà-öø-ÿA-ZÀ-Þ](?:-[{_UP}][\w'’]+)*"
NAME = re.compile(
    rf"(?<![\w@/#.&'’-])(?:(?P<g1>{_GIVEN})(?: [{_UP}]\.){{0,2}} (?P<f1>{_FAMILY})|(?P<g2>[{_UP}])\.(?: ?[{_UP}]\.){{0,2}} ?(?P<f2>{_FAMILY})|(?P<f3>{_FAMILY}), (?P<g3>{_GIVEN}|[{_UP}]\.)(?: [{_UP}]\.)?)(?![\w@'’/=(]|-\w)"
)
_ID_BEFORE = re.compile(rf"(?:^|(?<=\W))(?:{ID_WORDS})[ :.#-]*(?:n[oºr°]?\.?|number|nummer|num\.?|card)?[ :.#-]*$", re.I)
_PHONE_SEED = re.compile(r"^(?:\(?\+\d|00\d|\(\d{3}\) ?\d{3})")
_WORD = re.compile(r"[^\W\d_][\w'’-]*|\d+|[^\w\s]")
_BREAK_LEFT = re.compile(r"[\r\n;]| [-/|] |[.!?]\s+(?=\S)")
_BREAK_RIGHT = re.compile(r"[\r\n;]| [-/|] |[.!?](?:\s|$)")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")


def _words(text: str) -> list[str]:
    return ["0" if _DIGIT.search(t) else t.lower() for t in _WORD.findall(text)]


def _near(text: str, at: int, step: int) -> str:
    """The text before (step -1) or after (1) a place, as far as two tokens beyond the first need."""
    window = 80
    while True:
        part = text[max(0, at - window) : at] if step < 0 else text[at : at + window]
        if len(part) < window or len(_WORD.findall(part)) > 3 or (_BREAK_LEFT if step < 0 else _BREAK_RIGHT).search(part):
            return part
        window *= 8


def patterns_around(text: str, start: int, stop: int) -> list[str]:
    """The lexical patterns of a mention: two tokens left, two right, one on each side; at least one must be a word.

    Context ends at a line end, a semicolon, a dash or slash between blanks and the end of a sentence.
    """
    left = _BREAK_LEFT.split(EMAIL.sub("EMAIL", _near(text, start, -1)))[-1]
    right = _BREAK_RIGHT.split(EMAIL.sub("EMAIL", _near(text, stop, 1)), maxsplit=1)[0]
    before, after = _words(left)[-2:], _words(right)[:2]
    found = []
    if any(map(_LETTER.match, before)):
        found.append("L " + " ".join(before))
    if any(map(_LETTER.match, after)):
        found.append("R " + " ".join(after))
    if before and after and (_LETTER.match(before[-1]) or _LETTER.match(after[0])):
        found.append(f"B {before[-1]} _ {after[0]}")
    return found


def shape_of(text: str) -> str:
    """Digits and capitals by class, everything else as it is; white space is one blank."""
    return re.sub(r"\s+", " ", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text)))


def _before_mail(text: str, at: int) -> int:
    """Where the context before a mail address ends: before its bracket and scheme."""
    at -= text.startswith("<", at - 1) if at else 0
    return at - 7 if at >= 7 and text.startswith("mailto:", at - 7) else at


def candidates(text: str) -> Iterator[tuple[int, int, str, str, str, bool, list[str]]]:
    """(start, end, kind, instance, type seeded, seed?, patterns) of a text; kinds: address, email, number, name. Only the looser addresses, which are no seeds, may overlap others."""
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    for m in ADDRESS.finditer(text):
        a, b = m.span()
        taken.append((a, b))
        yield a, b, "address", m[0].lower(), "address", True, patterns_around(text, a, b)
    for pattern in (EMAIL, HIDDEN_EMAIL):
        for m in pattern.finditer(text):
            a, b = m.span()
            if free(a, b):
                taken.append((a, b))
                yield a, b, "email", m[0].lower(), "email", True, patterns_around(text, _before_mail(text, a), b + text.startswith(">", b))
    for pattern, kind in ((LOOSE_ADDRESS, "address"), (LOOSE_EMAIL, "email")):
        for m in pattern.finditer(text):
            a, b = m.span()
            b += text.count("(", a, b) > text.count(")", a, b) and text[b : b + 1] == ")"
            if free(a, b):
                yield a, b, kind, text[a:b].lower(), kind, False, patterns_around(text, a, b)
    for pattern in (NUMBER, _SIMPLE_ID):
        for m in pattern.finditer(text):
            a, b = m.span()
            while b > a and text[b - 1] in " .-/(":
                b -= 1
            if text[a] == "(" and ")" not in text[a:b]:
                a += 1
            if b > a and text[b - 1] == ")" and text.count("(", a, b) < text.count(")", a, b):
                b -= 1
            lead = re.match(r"[A-Z]+ ", text[a:b])
            if lead and _ID_BEFORE.search(text[: a + lead.end()]):
                a += lead.end()
            value = text[a:b]
            digits = sum(c.isdigit() for c in value)
            if len(value) < 7 or digits < 2 or not free(a, b) or digits < 6 and not re.fullmatch(r"[A-Z0-9]{7,}", value):
                continue
            named = _ID_BEFORE.search(text[max(0, a - 60) : a])
            kind = "id_number" if named else "phone" if _PHONE_SEED.match(value) and 7 <= digits <= 16 else ""
            first = max(0, a - 60) + named.start() if named else a
            taken.append((a, b))
            yield a, b, "number", shape_of(value), kind, bool(kind), patterns_around(text, first, b)
    at = 0
    while m := NAME.search(text, at):
        a, b = m.span()
        at = b
        given = m["g1"] or m["g2"] or m["g3"]
        if m["f3"]:
            # "Family, Given" within a list of words is tried first; a plain name that starts at the comma wins over it
            follow = re.match(rf" {_FAMILY}(?!\w)", text[b:])
            if follow and m["g3"] and not m["g3"].endswith("."):
                at = m.start("g3")
                continue
        family = m["f1"] or m["f2"] or m["f3"]
        if not free(a, b) or len(family) < 2:
            at = a + 1 + len(m[0].split(" ")[0]) if not free(a, b) else b
            continue
        if m["g1"]:
            more = re.match(rf" [{_UP}][\w'’-]+", text[b:])  # three and more capitalised words are a title, unless patterns say otherwise
            key = f"{given} {family}{more[0] if more else ''}"
        else:
            key = f"{given.rstrip('.')} {family}"
        yield a, b, "name", key.lower(), given.lower(), False, patterns_around(text, a, b)


_SMALL = re.compile(r"(?<![\w@/#.&'’+-])(?=([^\W\d_]+)( [^\W\d_][\w'’-]{3,})(?![\w@'’/=(]|-\w))")


def small_pairs(text: str, allowed: Callable[[str], bool]) -> Iterator[tuple]:
    """Names without capitals: two words in small letters, the first of them ``allowed``."""
    for m in _SMALL.finditer(text):
        given = m[1]
        if given.islower() and m[2].islower() and allowed(given):
            a, b = m.start(), m.start() + len(m[1]) + len(m[2])
            yield a, b, "small", m[1] + m[2], given, False, patterns_around(text, a, b)


FIELDS = [("src_table", pa.string()), ("src_field", pa.string()), ("record_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("told", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]


def _scan(texts: DataFrame, finder) -> DataFrame:
    """``finder`` over whole texts (src_table, src_field, record_id, text). Null and empty texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, f, r, *c) for t, f, r, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for c in finder(text)]
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], schema=pa.schema(FIELDS))

    wanted = texts.where("text is not null and text <> ''").select("src_table", "src_field", F.col("record_id").cast("long"), "text")
    return wanted.mapInArrow(run, "src_table string, src_field string, record_id long, start int, stop int, kind string, instance string, told string, seed boolean, patterns array<string>")


def find_candidates(texts: DataFrame) -> DataFrame:
    """Candidates of all kinds, names with capitals only."""
    return _scan(texts, candidates)


def _filter_of(given: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of ``bits`` bits with one bit set for each given name; at most bits / 64 rows reach the driver."""
    at = F.pmod(F.xxhash64("told"), F.lit(bits))
    rows = given.select((at / 64).cast("long").alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(told), {bits}L), 64L) as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("word")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[rows["cell"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return words.view(np.uint64)


def find_small_names(texts: DataFrame, given: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """Two words in small letters that begin with a believed given name (column told).

    The given names go to the workers as they are where they are few; else as a filter that lets some other words
    pass, and what passes is joined with them, which is exact.
    """
    if given.limit(most_names + 1).count() <= most_names:
        known = frozenset(r["told"] for r in given.collect())
        return _scan(texts, lambda text: small_pairs(text, known.__contains__))
    words = texts.sparkSession.sparkContext.broadcast(_filter_of(given))

    def may_be(word: str) -> bool:
        at = xxhash.xxh64_intdigest(word.encode(), 42)
        at = (at - (1 << 64) if at >= 1 << 63 else at) % FILTER_BITS
        return bool(int(words.value[at // 64]) >> (at % 64) & 1)

    return _scan(texts, lambda text: small_pairs(text, may_be)).join(given, "told", "left_semi").select(*(f for f, _ in FIELDS))


def score_graph(found: DataFrame, given: DataFrame, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """(pattern scores (pii_type, kind, pattern, strength, support, score), instance scores (pii_type, kind, instance, belief)).

    ``found`` are candidates that are written already, ``given`` one column of lower-case given names. Every round
    is two aggregations over the distinct (pattern, instance) edges; both combine before the shuffle, so a pattern
    or instance that most mentions share costs no more than any other.
    """
    known = given.select(F.lower("given").alias("told")).where("told is not null and length(told) > 1").distinct().withColumn("listed", F.lit(True))
    named = found.where("kind = 'name'").select("instance", "told").distinct().join(known, "told", "left").groupBy("instance").agg(F.max(F.coalesce("listed", F.lit(False))).alias("seed")).select(F.lit("name").alias("kind"), "instance", F.lit("person_name").alias("pii_type"), "seed")
    typed = found.where("kind <> 'name'").select("kind", "instance", F.col("told").alias("pii_type"), "seed")
    numbers = typed.where("kind = 'number'").groupBy("instance").agg(F.avg((F.col("pii_type") == "phone").cast("double")).alias("phone"), F.avg((F.col("pii_type") == "id_number").cast("double")).alias("id_number"))
    numbers = numbers.select(F.lit("number").alias("kind"), "instance", F.expr("stack(2, 'phone', phone, 'id_number', id_number)").alias("pii_type", "share")).select("kind", "instance", "pii_type", F.col("share").alias("belief"))
    addresses = typed.where("kind <> 'number'").groupBy("kind", "instance", "pii_type").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    start = named.select("kind", "instance", "pii_type", F.col("seed").cast("double").alias("belief")).unionByName(numbers).unionByName(addresses)
    beliefs = cut(start.select("kind", "instance", "pii_type", F.col("belief").alias("prior"), "belief"))
    edges = cut(found.select("kind", "instance", F.explode("patterns").alias("pattern")).distinct())
    while True:  # beliefs only grow, so they settle
        joined = edges.join(beliefs, ["kind", "instance"])
        strength = F.sum("belief")
        scores = joined.groupBy("pii_type", "kind", "pattern").agg(strength.alias("strength"), F.count("*").alias("support"))
        # numbers have few shapes, so two of them already back a pattern
        needed = F.when(F.col("kind") == "number", 1.0).otherwise(3.0)
        scores = scores.withColumn("score", F.col("strength") / F.col("support") * F.least(F.lit(1.0), F.col("strength") / needed))
        told = joined.select("kind", "instance", "pii_type", "pattern").join(scores.select("pii_type", "kind", "pattern", "score"), ["pii_type", "kind", "pattern"])
        heard = told.where(F.col("score") >= HEARD).groupBy("kind", "instance", "pii_type").agg((F.max("score") * DAMPING).alias("heard"))
        new = F.greatest("prior", F.coalesce("heard", F.lit(0.0)))
        moved = cut(beliefs.join(heard, ["kind", "instance", "pii_type"], "left").select("kind", "instance", "pii_type", "prior", new.alias("belief"), (new - F.col("belief")).alias("moved")))
        beliefs = moved.drop("moved")
        if (moved.agg(F.max("moved")).first()[0] or 0.0) <= settled:
            return cut(scores), beliefs
        tidy(found.sparkSession)


def find_mentions(texts: DataFrame, given: DataFrame) -> DataFrame:
    """(src_table, src_field, record_id, pii_type, start, stop, occurrence) of every mention of personal data.

    Repeated record ids are read one by one and their equal mentions count once. Empty tables give no row.
    """
    found = cut(find_candidates(texts))
    scores, beliefs = score_graph(found, given)
    # trusted patterns have shown which given names there are; now they find those written without capitals
    believed = beliefs.where("kind = 'name'").where(F.col("belief") >= TRUST).select("instance")
    learned = found.where("kind = 'name' and length(told) > 1").select("instance", "told").distinct().join(believed, "instance").groupBy("told").agg(F.count("*").alias("families")).where("families >= 3").select("told")
    names = cut(learned.unionByName(given.select(F.lower("given").alias("told"))).where("told is not null").distinct())
    small = find_small_names(texts, names)

    keys = ["src_table", "src_field", "record_id", "start"]
    of = lambda t, col: F.max(F.when(F.col("pii_type") == t, F.col(col)))
    kinds = F.when(F.col("kind") == "name", F.array(F.lit("name"), F.lit("small"))).otherwise(F.array("kind"))
    shares = [f"{t}_share" for t in TYPES]
    weighed = scores.withColumn("share", F.col("strength") / F.col("support")).withColumn("weight", F.least(F.lit(1.0), F.col("support") / 3.0))
    per_pattern = weighed.groupBy("kind", "pattern").agg(*(of(t, "score").alias(t) for t in TYPES), *(of(t, "share").alias(f"{t}_share") for t in TYPES), F.max("weight").alias("weight")).select(F.explode(kinds).alias("kind"), "pattern", "weight", *TYPES, *shares)
    own_share = F.coalesce(*(F.when(F.col("told") == t, F.col(f"{t}_share")) for t in TYPES), F.lit(0.0))
    known = beliefs.where("kind <> 'number'").select("kind", "instance", F.col("belief").alias("known"))
    own = [*keys, "stop", "kind", "instance", "told", "seed"]
    spread = found.unionByName(small).select(*own, F.explode_outer("patterns").alias("pattern"))
    best = lambda t: F.coalesce(F.max(t), F.lit(0.0)).alias(t)
    rated = spread.join(per_pattern, ["kind", "pattern"], "left").groupBy(*own).agg(*map(best, TYPES), F.count(F.coalesce("person_name", "address", "email")).alias("heard"), (F.lit(1.0) + F.coalesce(F.sum(F.col("weight") * own_share), F.lit(0.0))).alias("agreed"), (F.lit(1.0) + F.coalesce(F.sum("weight"), F.lit(0.0))).alias("votes"))
    rated = rated.join(known, ["kind", "instance"], "left")
    pii_type = (
        F.when(F.col("seed") & (F.col("agreed") / F.col("votes") >= TRUST), F.col("told"))
        .when((F.col("kind") == "address") & (F.col("address") >= TRUST), F.lit("address"))
        .when((F.col("kind") == "email") & (F.col("email") >= TRUST), F.lit("email"))
        .when(F.col("kind").isin("address", "email") & (F.col("heard") == 0) & (F.col("known") >= TRUST), F.col("kind"))
        .when((F.col("kind") == "number") & (F.col("phone") >= TRUST) & (F.col("phone") >= F.col("id_number")), F.lit("phone"))
        .when((F.col("kind") == "number") & (F.col("id_number") >= TRUST), F.lit("id_number"))
        .when(F.col("kind").isin("name", "small") & (F.col("person_name") >= TRUST), F.lit("person_name"))
        .when((F.col("kind") == "name") & (F.col("heard") == 0) & (F.col("known") >= TRUST), F.lit("person_name"))
    )
    kept = rated.select(*keys, "stop", pii_type.alias("pii_type")).where("pii_type is not null")
    one = Window.partitionBy(*keys).orderBy(F.desc("stop"), "pii_type")
    kept = kept.withColumn("nth", F.row_number().over(one)).where("nth = 1")
    order = Window.partitionBy("src_table", "src_field", "record_id", "pii_type").orderBy("start")
    before = F.coalesce(F.max("stop").over(Window.partitionBy("src_table", "src_field", "record_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("before", before).where("start >= before")
    return kept.select("src_table", "src_field", "record_id", "pii_type", "start", "stop", F.row_number().over(order).alias("occurrence"))


def redact_texts(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(src_table, src_field, record_id, text) with a typed placeholder such as [EMAIL] for each mention, the rest unchanged."""
    spans = mentions.groupBy("src_table", "src_field", "record_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "pii_type"))).alias("spans"))

    @F.pandas_udf("string")
    def rewrite(text, spans):
        out = []
        for t, own in zip(text, spans, strict=True):
            if t is None or own is None:
                out.append(t)
                continue
            parts, at = [], 0
            for s in own:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], f"[{s['pii_type'].upper()}]"]
                    at = s["stop"]
            out.append("".join([*parts, t[at:]]))
        return type(text)(out)

    joined = texts.join(spans, ["src_table", "src_field", "record_id"], "left")
    return joined.select("src_table", "src_field", "record_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rewrite("text", "spans")).alias("text"))
