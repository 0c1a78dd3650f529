"""Variant spellings of the names of people and organisations, linked by merge and rematch.

Every signature is read into name claims (given name or initial, family name, whether an address or login
confirms the spelling) and into static keys (addresses, logins, organisation names). Signatures that share
a key merge; a merged profile unions the claims of its members, so a nickname learns the full name of a
colleague signature's address, an initial its given name, a typo its confirmed spelling. Richer profiles
re-enter blocking with more keys, and rounds go on until nothing merges any more.

Blocking keys are exact, so a block never expands into pairs: its members link to one representative.
Typing errors are found by keys with one letter left out; a spelling that an address confirms never merges
with another confirmed spelling that way. An initial joins the only full name in its block, or none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import cut, tidy

#: Up to so many known given names go to the workers; beyond, the words of each signature are joined with them.
MOST_NAMES = 50_000
#: Left rows of a pair that one task joins with the whole group.
PAIR_ROWS = 2_000
#: Words of organisation names, legal forms, role mailboxes and what people add to names and logins.
ORG_WORDS = frozenset("lab labs research partners systems works logistics analytics data commerce retail insight insights basket group holding team studio university institute foundation technologies software solutions services consulting media bank trust agency".split())
LEGAL_FORMS = frozenset("gmbh ag ltd limited llc inc corp co plc sa sas sarl srl spa bv nv oy ab kg kgaa se".split())
ROLES = frozenset("dev root you build noreply no-reply ci team info admin bot git mail me user user1 contact hello support office webmaster nobody test localhost jenkins".split())
_DECORATION = re.compile(r"\([^)]*\)|\[[^\]]*\]|\|.*$|,\s*(?:ph\.?d|dr|m\.?sc|b\.?sc|md|mba|jr|sr|ii|iii|esq)\.?\s*$|^\s*(?:dr|prof|mr|mrs|ms|herr|frau|mme)\.?\s+", re.I)
_LOGIN_TAIL = re.compile(r"[-_.]?(?:work|dev|git|bot|private|home|office|laptop|mobile)$")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")


def fold(text: str | None) -> str:
    """Small letters without marks."""
    text = unicodedata.normalize("NFKD", (text or "").lower().replace("ø", "o").replace("ß", "ss").replace("ł", "l").replace("đ", "d"))
    return "".join(c for c in text if not unicodedata.combining(c))


def _repaired(text: str) -> str:
    """Text whose UTF-8 bytes were read as Latin-1, read again."""
    if "Ã" in text or "Â" in text or "Å" in text:
        try:
            return text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            try:
                return text.encode("latin-1").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                return text
    return text


def left_out(word: str) -> set[str]:
    """The word and all spellings with one letter left out."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a: str, b: str) -> bool:
    """At most one letter inserted, left out, replaced or two neighbours swapped (or as far apart as that allows twice)."""
    return a == b or not left_out(a).isdisjoint(left_out(b))


def claims_of_login(login: str, known: frozenset[str]) -> list[tuple[str, str, bool]]:
    """(given or initial, family, told) readings of a login or the local part of an address; told: by a separator. Without one, every known given name at either end and both initials are tried, unless the word ends in a number: that is an invented handle, which tells nothing about a name."""
    whole = fold(login).strip("-_.")
    login = _LOGIN_TAIL.sub("", re.sub(r"\d+$", "", whole).strip("-_."))
    parts = [p for p in re.split(r"[._-]+", login) if p]
    if not all(p.isalpha() for p in parts) or len(parts) == 1 and re.search(r"\d{2,}$", whole):
        return []
    if len(parts) == 2:
        a, b = parts
        if len(a) == 1 or a in known or (b not in known and len(b) > 1):
            return [(a, b, True)] + ([] if len(a) == 1 or a in known else [(b, a, False)])
        return [(b, a, True)]
    if len(parts) == 1 and len(login) >= 5:
        found = [(login[:k], login[k:], False) for k in range(2, len(login) - 3) if login[:k] in known]
        found += [(login[k:], login[:k], False) for k in range(4, len(login) - 1) if login[k:] in known]
        return found + [(login[0], login[1:], False), (login[-1], login[:-1], False)]
    return []


def read_signature(name: str | None, email: str | None, login: str | None, known: frozenset[str]) -> tuple[list[tuple[str, str, bool]], list[str]]:
    """(name claims (given or initial, family, confirmed), static keys) of one signature."""
    email = (email or "").strip().lower()
    local, _, domain = email.partition("@")
    local = local.split("+")[1] if domain.startswith("users.noreply") and "+" in local else local.split("+")[0]
    stem = domain.split(".")[0]
    keys: list[str] = []
    claims: list[tuple[str, str, bool]] = []
    typed = _repaired(name or login or "").strip()
    handles: list[str] = []
    # ---- what is typed
    plain = _DECORATION.sub(" ", typed).strip(" ,;")
    org = None
    bot = typed.lower().endswith("[bot]")
    words = [plain] if re.fullmatch(r"\S*[\d_.]\S*", plain) and not plain.endswith(".") else [w for w in re.split(r"\s+", _CAMEL.sub(" ", plain) if " " not in plain and not plain.islower() and not plain.isupper() else plain) if w]
    flat = [fold(w).strip(".,") for w in re.split(r"[\s-]+", " ".join(words)) if fold(w).strip(".,")]
    if flat and flat[0] == "the":
        flat = flat[1:]
    if len(flat) > 1 and flat[-1] == "team":
        flat = flat[:-1]
    legal = len(flat) > 1 and flat[-1].replace(".", "") in LEGAL_FORMS
    if legal:
        flat = flat[:-1]
    if len(flat) > 1 and (legal or bot or set(flat[1:]) & ORG_WORDS):
        org = flat
    elif len(flat) == 2 and (re.fullmatch(r"[A-Z]{2,4}", words[-1]) and not plain.isupper() or words[-1].endswith(".") and len(words[-1]) > 2):
        org = flat  # abbreviated kind of organisation
    elif "," in plain:
        family, given = (fold(x).strip(" .") for x in plain.split(",", 1))
        given = given.split(" ")[0] if given else ""
        if family and given:
            claims.append((given, family.replace(" ", "-"), False))
    elif len(words) == 1:
        handles.append(plain)
    elif words:
        people = [fold(w).strip(".,") for w in words]
        people = [w for i, w in enumerate(people) if len(w) > 1 or i == 0 or i == len(people) - 1]
        if len(people) >= 2:
            a, b = people[0], "-".join(people[1:])
            if len(people) == 2 and a not in known and (people[1] in known or len(people[1]) == 1) and len(a) > 1:
                a, b = people[1], a
            claims.append((a, b, False))
    # ---- addresses
    org_domain = [t for t in fold(stem).split("-") if t]
    if org is None and len(org_domain) > 1 and set(org_domain[1:]) & ORG_WORDS and not domain.startswith("users."):
        org = org or org_domain
    if org is not None:
        spelled = [org]
        if len(org_domain) > 1 and set(org_domain[1:]) & ORG_WORDS:
            spelled.append(org_domain)
        for k, words_of in enumerate(spelled):
            head, kind = words_of[0], words_of[1:]
            sure = 1 if k or "-".join(words_of) == "-".join(org_domain) else 0
            keys.append("O" + "-".join(words_of))
            if len(kind) > 1:
                keys.append(f"O{head}|{''.join(w[0] for w in kind)}")
            elif kind and len(kind[0]) >= 2:
                keys.append(f"O{head}|{kind[0][:4]}")
            if len(spelled) == 1 and not sure:
                keys += [f"T{x}|{'-'.join(kind)}" for x in left_out(head)]
            elif sure:
                keys += [f"t{x}|{'-'.join(kind)}" for x in left_out(head)]
        return [], sorted(set(keys))
    if login and not handles and not claims:
        handles.append(login)
    told: list[tuple[str, str, bool]] = []
    generic = local in ROLES or domain in ("localhost",) or not local
    if email and not generic:
        if domain.endswith(".local") and stem.endswith("-box"):
            told = [(fold(local), fold(stem[:-4]), True)]
        else:
            told = claims_of_login(local, known)
        family = claims[0][1] if claims else ""
        given = claims[0][0] if claims else ""
        place = fold(local + "@" + stem)
        related = not claims or family in place or any(near(f, family) for _, f, _ in told) or (len(given) > 2 and given in place)
        pseudonym = bool(re.fullmatch(r"[a-z]+\d{2,}", local))
        if related:
            keys.append("E" + email.replace("+" + email.partition("@")[0].split("+")[-1], "") if "+" in email and not domain.startswith("users.") else "E" + email)
        if pseudonym:
            keys.append("L" + local)
        if not related and family:
            keys += [f"E{email}|^{family[:3]}", f"E{email}|${family[-3:]}"]
        if claims:
            told = [c for c in told if near(c[1], family)]
    elif email and claims:
        keys += [f"E{email}|{claims[0][0][:1]}^{claims[0][1][:4]}", f"E{email}|{claims[0][0][:1]}${claims[0][1][-4:]}"]
    for handle in handles:
        short = fold(handle)
        if re.search(r"\d{2,}$", short):
            keys.append("L" + short)
        readings = claims_of_login(handle, known)
        if told:
            readings = [c for c in readings if any(near(c[1], f) for _, f, _ in told)] or readings
        told = told + readings
        if not readings or len(short) >= 5:
            keys.append("H" + short)
    if told and not claims:
        sure = [c for c in told if c[2]]
        claims = [(g, f, len(g) > 1 and t) for g, f, t in (sure or told)]
    elif told:
        given, family, _ = claims[0]
        confirmed = any(f == family for _, f, _ in told) or family in fold(local + " " + stem)
        claims = [(given, family, confirmed)] + [(g, f, True) for g, f, t in told if t and (len(g) > 1 or f != family)]
        claims += [(given, f, True) for g, f, t in told if f != family and (g[0] == given[0] or t and len(given) > 1)]
    elif claims and claims[0][1] in fold(local + stem):
        claims = [(claims[0][0], claims[0][1], True)]
    return sorted({c for c in claims if c[0] and len(c[1]) >= 2}), sorted(set(keys))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of edges (a, b), by least-neighbour rounds with pointer jumping."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:  # every round lowers a root or is the last
        least = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = roots.join(least, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = step.alias("s").join(roots.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = cut(jump.select("node", F.col("old"), F.least("root", F.coalesce("next", "root")).alias("root")))
        done = moved.where("old <> root").isEmpty()
        roots = moved.select("node", "root")
        if done:
            break
        tidy(edges.sparkSession)
    return roots


def given_names_of(signatures: DataFrame, listed: DataFrame) -> DataFrame:
    """(word): given names, folded. Those listed, and learned ones: words that stand beside at least six different others in names of two words, most of which stand beside fewer than half as many (so a common family name is none, however many people there are)."""
    folded = F.pandas_udf(lambda s: s.map(lambda x: fold(x).strip(".,"), na_action="ignore"), "string")
    plain = F.coalesce("author_name", "user_login")
    two = signatures.select(F.split(F.trim(plain), r"[ ,]+").alias("w")).where("size(w) = 2").select(F.col("w")[0].alias("x"), F.col("w")[1].alias("y")).where("length(x) > 1 and length(y) > 1").where(~F.col("x").rlike(r"^[A-Z]{2,4}$|\.$") & ~F.col("y").rlike(r"^[A-Z]{2,4}$|\.$")).distinct()
    two = two.select(folded("x").alias("x"), folded("y").alias("y"))
    beside = cut(two.unionByName(two.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("length(x) > 1 and length(y) > 1").distinct())
    counts = beside.groupBy("x").agg(F.count("*").alias("n"))
    weighed = beside.join(counts.where("n >= 6"), "x").join(counts.select(F.col("x").alias("y"), F.col("n").alias("m")), "y")
    learned = weighed.groupBy("x").agg(F.avg((F.col("n") > 2 * F.col("m")).cast("double")).alias("share")).where("share >= 0.75").select(F.col("x").alias("word"))
    return learned.unionByName(listed.select(folded("g").alias("word"))).where("length(word) > 1").where(F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").isin(*sorted(ORG_WORDS))).distinct()


def _words_of(name: str | None, email: str | None, login: str | None) -> list[str]:
    """Every word that reading a signature may look up: its words, and all beginnings and ends of handles."""
    found: set[str] = set()
    for text in (_repaired(name or ""), login or "", (email or "").partition("@")[0], (email or "").partition("+")[2].partition("@")[0]):
        for w in re.findall(r"[^\W\d_]+", fold(text)) + re.findall(r"[^\W\d_]+", fold(_CAMEL.sub(" ", text))):
            found |= {w} | {w[:k] for k in range(2, len(w))} | {w[k:] for k in range(1, len(w) - 1)}
    return sorted(w for w in found if len(w) > 1)


def _with_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (sig, name, email, login) with the given names among their words; for when those do not fit into every worker."""
    words = F.pandas_udf(lambda n, e, u: n.combine(e, lambda a, b: (a, b)).combine(u, lambda ab, c: _words_of(*ab, c)), "array<string>")
    spread = rows.select("sig", F.explode(words("name", "email", "login")).alias("word"))
    own = spread.join(known, "word").groupBy("sig").agg(F.collect_set("word").alias("known"))
    return rows.join(own, "sig", "left")


def link_signatures(signatures: DataFrame, given_names: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """(signature_id, entity): the least signature id of the same person or organisation, one row per signature.

    Signatures without any name, address and login stay alone; so do role addresses without a name. Repeated
    rows merge by their equal keys. Empty tables give an empty result.
    """
    listed = given_names.select(F.col("given_name").alias("g")).unionByName(given_names.select(F.col("short_form").alias("g"))).where("g is not null").distinct()
    given = cut(given_names_of(signatures, listed))
    few = given.limit(most_names + 1).count() <= most_names
    everywhere = frozenset(r["word"] for r in given.collect()) if few else None
    rows = signatures.select(F.col("signature_id").cast("long").alias("sig"), F.col("author_name").alias("name"), F.col("author_email").alias("email"), F.col("user_login").alias("login"))
    rows = rows.withColumn("known", F.lit(None).cast("array<string>")) if few else _with_known(rows, given)
    schema = pa.schema([("sig", pa.int64()), ("claims", pa.list_(pa.struct([("given", pa.string()), ("family", pa.string()), ("sure", pa.bool_())]))), ("keys", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [read_signature(n, e, u, frozenset(own or ()) if everywhere is None else everywhere) for n, e, u, own in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            claims = [[{"given": g, "family": f, "sure": s} for g, f, s in c] for c, _ in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(claims, schema[1].type), pa.array([k for _, k in each], schema[2].type)], schema=schema)

    read = cut(rows.select("sig", "name", "email", "login", "known").mapInArrow(run, "sig long, claims array<struct<given:string,family:string,sure:boolean>>, keys array<string>"))
    short = given_names.where("short_form is not null").select(F.lower("short_form").alias("given"), F.lower("given_name").alias("full"))
    claims = read.select("sig", F.explode("claims").alias("c")).select("sig", "c.given", "c.family", "c.sure")
    # a nickname that stands beside the same full name for several families is learned
    pairs = claims.alias("x").join(claims.where("sure and length(given) > 2").select("sig", F.col("given").alias("full"), F.col("family").alias("own")), "sig").where("given <> full and length(given) > 1 and not sure or (given <> full and length(given) > 1 and family = own)")
    learned = pairs.groupBy("given", "full").agg(F.count_distinct("family").alias("n")).where("n >= 2").select("given", "full")
    nick = cut(short.unionByName(learned).distinct())
    claims = cut(claims.unionByName(claims.join(nick, "given").select("sig", F.col("full").alias("given"), "family", "sure")).distinct())
    fixed = cut(read.select("sig", F.explode("keys").alias("key")))
    labels = cut(read.select("sig", F.col("sig").alias("label")).distinct())

    for turn in count():  # every round merges profiles or is the last
        tidy(signatures.sparkSession)
        mine = claims.join(labels, "sig").groupBy("label", "given", "family").agg(F.max("sure").alias("sure"))
        mine = cut(mine)
        full = mine.where("length(given) > 1")
        # union of the profile: every given name of it with every family spelling of it
        givens, families = full.select("label", "given").distinct(), mine.groupBy("label", "family").agg(F.max("sure").alias("sure"))
        united = cut(givens.join(families, "label"))
        named = united.select("label", F.concat(F.lit("F"), "given", F.lit("|"), "family").alias("key"))
        if turn == 0:
            static = fixed.where("substring(key, 1, 1) not in ('T', 't')").join(labels, "sig").select("label", "key")
            links = _to_least(named.unionByName(static))
        else:
            half = lambda word, other, tag: F.explode(F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.concat(F.lit(tag), F.when(i == 0, F.col(word)).otherwise(F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.length(word)))), F.lit("|"), F.col(other))))
            by_family = united.where("length(family) >= 5").select("label", "sure", half("family", "given", "V").alias("key"))
            by_given = united.where("length(given) >= 4").select("label", F.lit(False).alias("sure"), half("given", "family", "G").alias("key"))
            orgs = fixed.where("substring(key, 1, 1) in ('T', 't')").join(labels, "sig").select("label", (F.substring("key", 1, 1) == "t").alias("sure"), F.concat(F.lit("T"), F.expr("substring(key, 2)")).alias("key"))
            links = _to_least(named).unionByName(_to_confirmed(by_family.unionByName(by_given).unionByName(orgs))).unionByName(_initials(mine, united))
        links = cut(links.where("a <> b").distinct())
        if links.isEmpty() and turn:
            break
        roots = components(links)
        labels = cut(labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select("sig", F.coalesce("root", "label").alias("label")))
    return labels.select(F.col("sig").alias("signature_id"), F.col("label").alias("entity"))


def _to_least(keyed: DataFrame) -> DataFrame:
    """Links from every profile of a key to the least of them."""
    keyed = keyed.distinct()
    least = keyed.groupBy("key").agg(F.min("label").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    return keyed.join(least, "key").select(F.col("label").alias("a"), "b")


def _to_confirmed(keyed: DataFrame) -> DataFrame:
    """Links of unconfirmed profiles to the only confirmed one of a key, or among themselves where none is confirmed."""
    keyed = keyed.groupBy("key", "label").agg(F.max("sure").alias("sure"))
    sure = F.when(F.col("sure"), F.col("label"))
    block = keyed.groupBy("key").agg(F.min("label").alias("least"), F.min(sure).alias("low"), F.max(sure).alias("high"), F.count("*").alias("n")).where("n > 1 and (low is null or low = high)")
    return keyed.join(block.select("key", F.coalesce("low", "least").alias("b")), "key").where(~F.col("sure") | (F.col("label") == F.col("b"))).select(F.col("label").alias("a"), "b")


def _initials(mine: DataFrame, united: DataFrame) -> DataFrame:
    """Links of profiles without a confirmed full name, through their initials, to the one profile with a full given name in their block."""
    has_full = mine.where("length(given) > 1 and sure").select("label").distinct()
    bare = mine.where("length(given) = 1").join(has_full, "label", "left_anti").select("label", F.concat(F.lit("I"), "given", F.lit("|"), "family").alias("key")).distinct()
    full = united.select("label", F.concat(F.lit("I"), F.substring("given", 1, 1), F.lit("|"), "family").alias("key")).distinct()
    block = full.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    first = bare.groupBy("key").agg(F.min("label").alias("least"))
    target = first.join(block, "key", "left").where("low is null or low = high").select("key", F.coalesce("low", "least").alias("b"))
    return bare.join(target, "key").select(F.col("label").alias("a"), "b")


def pairs_of(entities: DataFrame, rows: int = PAIR_ROWS) -> DataFrame:
    """(signature_a, signature_b) of the same entity, a < b; every pair of a group, as that is the result asked for. A group of more than ``rows`` rows is split on the left side and repeated on the right, so no task pairs all of it."""
    sizes = entities.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / rows).cast("int"))
    grouped = entities.join(sizes, "entity")
    left = grouped.select("entity", F.pmod(F.xxhash64("signature_id"), F.col("parts")).cast("int").alias("part"), F.col("signature_id").alias("signature_a"))
    right = grouped.select("entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("signature_id").alias("signature_b"))
    return left.join(right, ["entity", "part"]).where("signature_a < signature_b").select("signature_a", "signature_b")
