"""Keyed surrogates for personal data.

One pattern finds mentions of e-mail addresses, phone, card, social-security and account numbers,
IP addresses, access keys and names (after a title, or a known first name with a surname). A
mention is cut into parts, each with a type and a normal form: letters lowered, digits alone, a
phone number's last ten digits; so all ways to write an entity are one entity. A part's surrogate
is drawn from SHA-256 of the secret key, type, normal form and attempt: digits for digits, letters
of the same script for letters, a first name of the same gender, a valid check digit where the
original has one. It is rendered in the mention's own punctuation and case.

Collision checks keep entities apart: of entities that draw one surrogate the least keeps it, and
nobody may draw what stands in the corpus or is taken; the others draw again, from a space that
grows with the attempts. The mapping is a table; a mention looks it up by an equi-join.

Only DataFrame functions. Texts without digits, at-signs and names are not matched further.

Cases: null and empty texts pass; repeated rows get equal surrogates; rows equal in id and text
are treated alike; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.words import let
from gridwake.session import stage

#: First names and titles by gender and script.
FIRST = {
    "latin": {
        "m": "James John Robert Michael David William Richard Thomas Charles Daniel Matthew Anthony Peter Paul Hans Klaus Jürgen Wolfgang Stefan Andreas Jean Pierre Michel François Jacques Louis José Juan Carlos Miguel Pedro Luis".split(),
        "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Emily Anna Julia Ursula Monika Petra Sabine Heike Claudia Marie Jeanne Catherine Sophie Isabelle Nathalie María Carmen Ana Lucía Elena Isabel".split(),
    },
    "cyrillic": {
        "m": "Иван Пётр Алексей Сергей Дмитрий Николай Владимир Андрей Михаил Олег Павел Юрий".split(),
        "f": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Вера Нина".split(),
    },
}
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Don Господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Госпожа".split(),
    "n": "Dr Prof".split(),
}
SYLLABLES = {
    "latin": "ba be do fi ga ho ka la le mi mo na ra ri sa so ta te to va ve vi wa zo".split(),
    "cyrillic": "ба бе до фи га ла ле ми мо на ра ри са со та те то ва ве ви зо ку лу ню".split(),
}
ENDINGS = {"m": "ов", "f": "ова", "n": "ко"}
LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for group in TITLES.values() for t in group)
_FIRST = "|".join(n for script in FIRST.values() for group in script.values() for n in [*group, *(x.upper() for x in group)])
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ip": rf"(?<![\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{N}}]|\.[0-9])",
    "account": _START + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "social": _START + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "card": _START + r"(?:[0-9]{4}[ -]?){3}[0-9]{1,7}" + _END,
    "phone": r"(?<![\p{N}.+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}" + _END + r"|(?<![\p{N}.+(])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}" + _END,
    "key": _START + r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,})" + _END,
    "name": _START + rf"(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_FIRST}) {_NAME})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap conditions without which no pattern can match.
HINT = rf"[0-9@]|{_START}(?:{_TITLE}|{_FIRST})[ .]"
MAX_ATTEMPTS = 60


def _type(mention: Column) -> Column:
    out = F.lit("name")
    for name in reversed([n for n in PATTERNS if n != "name"]):
        out = F.when(mention.rlike(rf"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _in(word: Column, names: list[str]) -> Column:
    return F.lower(word).isin([n.lower() for n in names])


def _parts(mention: Column, kind: Column) -> Column:
    """Array of (type, raw, normal form); a type of null is copied as it is."""

    def part(t: Column, raw: Column, norm: Column) -> Column:
        return F.struct(t.cast("string").alias("type"), raw.alias("raw"), norm.alias("norm"))

    digits = F.regexp_replace(mention, "[^0-9]", "")
    norm = (
        F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "social"), digits)
        .when(kind == "account", F.upper(F.regexp_replace(mention, " ", ""))).when(kind.isin("email", "key"), F.lower(mention)).otherwise(mention)
    )
    words = F.split(mention, " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    titled = _in(title, [t for group in TITLES.values() for t in group])
    male = [n for s in FIRST.values() for n in s["m"]]
    female = [n for s in FIRST.values() for n in s["f"]]
    first = F.when(titled & (F.size(words) > 2), F.get(words, F.lit(1))).when(~titled, F.get(words, F.lit(0)))
    gender = (
        F.when(titled & _in(title, TITLES["m"]), "m").when(titled & _in(title, TITLES["f"]), "f")
        .when(_in(first, male), "m").when(_in(first, female), "f").otherwise("n")
    )

    def named(word: Column, i: Column) -> Column:
        is_last = i == F.size(words) - 1
        t = F.when(titled & (i == 0), F.lit(None)).when(is_last, F.lit("surname")).otherwise(F.concat(F.lit("first_"), gender))
        slavic = word.rlike(r"\p{IsCyrillic}")
        return part(F.when(is_last & slavic, F.concat(F.lit("surname_"), gender)).otherwise(t), word, F.lower(word))

    return F.when(kind == "name", F.transform(words, named)).otherwise(F.array(part(kind, mention, norm)))


def mentions(docs: DataFrame, text: str = "text") -> Column:
    body = F.col(f"`{text}`")
    return F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(f"({ANY})"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _draws(key: str, kind: Column, norm: Column, attempt: int, length: Column) -> Column:
    """One number from 0 to 255 per place, from as many hash blocks as needed."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(length, F.lit(1)) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(attempt)), b.cast("string")), 256))
    return let(F.array_join(blocks, ""), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) + 7), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def _pick(items: list[str] | str, n: Column) -> Column:
    return F.get(F.lit(list(items)), (n % len(items)).cast("int"))


def _letters(norm: Column, draws: Column, kind: Column) -> Column:
    """A character of the same class in each place; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        n = F.get(draws, i)
        hex_ = F.when((kind == "key") & norm.rlike("^[0-9a-f]+$"), _pick("0123456789abcdef", n))
        latin = F.when(c.rlike(r"\p{Lu}"), F.upper(_pick(LOWER["latin"], n))).otherwise(_pick(LOWER["latin"], n))
        plain = (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike(r"\p{IsCyrillic}"), _pick(LOWER["cyrillic"], n)).when(c.rlike(r"\p{IsGreek}"), _pick(LOWER["greek"], n))
            .when(c.rlike(r"\p{L}"), latin).otherwise(c)
        )
        return F.coalesce(hex_, plain)

    return F.array_join(F.transform(F.split(norm, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string modulo ten."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), weight), F.lit(0), lambda a, x: a + x) % 10


def draw(key: str, attempt: int) -> Column:
    """The surrogate in normal form that the entity `type, norm` draws at an attempt."""
    kind, norm = F.col("type"), F.col("norm")
    more = attempt // 4

    def of(d: Column) -> Column:
        at = lambda k: F.get(d, F.lit(k))
        mixed = _letters(norm, d, kind)
        local = _letters(F.regexp_extract(norm, "^([^@]*)@", 1), d, kind)
        host = _letters(F.regexp_extract(norm, r"@([^.]*)", 1), F.slice(d, F.length(F.regexp_extract(norm, "^([^@]*)@", 1)) + 1, 300), kind)
        email = F.concat(local, F.lit(str(attempt) if attempt > 3 else ""), F.lit("@"), host, F.lit(".example."), F.regexp_extract(norm, r"([^.]+)$", 1))
        checked = let(F.concat(F.substring(norm, 1, 1), F.substring(mixed, F.lit(2), F.length(norm) - 2)), lambda head: F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0")))) % 10).cast("string")))
        card = F.when(_luhn(norm) == 0, checked).otherwise(mixed)
        ip = F.concat_ws(".", *[(at(k) % 254 + 1).cast("string") for k in range(4)])
        account = F.concat(F.substring(norm, 1, 2), F.substring(F.upper(mixed), F.lit(3), F.length(norm)))
        prefix = F.regexp_extract(norm, "^(akia|asia|gh[pousr]_|sk-|)", 1)
        token = F.concat(prefix, F.substring(mixed, F.length(prefix) + 1, F.length(norm)))
        slavic = norm.rlike(r"\p{IsCyrillic}")
        made = lambda s, k0, n: F.concat(*[_pick(SYLLABLES[s], at(k0 + k)) for k in range(n)])
        surname = F.when(slavic, made("cyrillic", 0, 3 + more % 4)).otherwise(made("latin", 0, 3 + more % 4))
        ending = F.when(kind == "surname_m", ENDINGS["m"]).when(kind == "surname_f", ENDINGS["f"]).when(kind == "surname_n", ENDINGS["n"]).otherwise("")
        both = lambda s: [*FIRST[s]["m"], *FIRST[s]["f"]]

        def first(s: str) -> Column:
            known = F.when(kind == "first_m", _pick(FIRST[s]["m"], at(0))).when(kind == "first_f", _pick(FIRST[s]["f"], at(0))).otherwise(_pick(both(s), at(0)))
            return F.lower(known) if attempt < 4 else F.concat(F.lower(known), F.lit("-"), made(s, 1, 1 + more % 6))

        return (
            F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "account", account).when(kind == "key", token)
            .when(kind.startswith("surname"), F.concat(surname, ending)).when(kind.startswith("first"), F.when(slavic, first("cyrillic")).otherwise(first("latin"))).otherwise(mixed)
        )

    return let(_draws(key, kind, norm, attempt, F.length(norm)), of)


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """`type, norm, surrogate`, one-to-one within a type, and no surrogate is an entity of its type."""
    pending = stage(entities.select("type", "norm").distinct())
    known, done = pending.select("type", F.col("norm").alias("surrogate")), None
    for attempt in range(MAX_ATTEMPTS):
        drawn = stage(pending.withColumn("surrogate", draw(key, attempt)))
        free = drawn.join(known, ["type", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = stage(free.groupBy("type", "surrogate").agg(F.min("norm").alias("norm")).select("type", "norm", "surrogate"))
        done = won if done is None else done.unionByName(won)
        pending = stage(pending.join(won, ["type", "norm"], "left_anti"))
        if pending.isEmpty():
            return done
    raise RuntimeError("surrogates collide; the drawing space of a type is too small")


def _rendered(raw: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the punctuation and case of the mention."""

    def digits(s: Column) -> Column:
        spare = F.length(F.regexp_replace(raw, "[^0-9]", "")) - F.length(s)  # leading digits that stay, as a country code
        step = lambda acc, c: F.when(
            c.rlike("[0-9]"),
            F.struct(F.concat(acc["t"], F.when(acc["k"] < spare, c).otherwise(F.substring(s, acc["k"] - spare + 1, F.lit(1)))).alias("t"), (acc["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.concat(acc["t"], c).alias("t"), acc["k"].alias("k")))
        return F.aggregate(F.split(raw, ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), step)["t"]

    spaced = F.when(raw.contains(" "), F.regexp_replace(surrogate, "(.{4})(?=.)", "$1 ")).otherwise(surrogate)
    upper = (F.upper(raw) == raw) & raw.rlike(r"\p{Lu}")
    cased = F.when(upper, F.upper(surrogate)).when(raw.rlike(r"^\p{Lu}\p{Ll}"), F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "social"), digits(surrogate)).when(kind == "account", spaced).when(kind == "ip", surrogate).otherwise(cased)


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text", count: str = "n_replaced") -> DataFrame:
    """`docs` with surrogates in the text, and how many mentions were replaced."""
    body = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.xxhash64(f"`{text}`").alias("text_key"), mentions(docs, text).alias("m")).filter(F.size("m") > 0)
    each = slim.dropDuplicates(["id", "text_key"]).select("id", "text_key", F.posexplode("m").alias("pos", "mention")).withColumn("kind", _type(F.col("mention")))
    parts = stage(each.select("id", "text_key", "pos", F.posexplode(_parts(F.col("mention"), F.col("kind"))).alias("part", "p")).select("id", "text_key", "pos", "part", "p.*"))
    pairs = mapping(parts.filter("type is not null"), key)
    told = parts.join(pairs, ["type", "norm"], "left").select("id", "text_key", "pos", "part", F.coalesce(_rendered(F.col("raw"), F.col("type"), F.col("surrogate")), F.col("raw")).alias("new"))
    lists = told.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "new"))).alias("found"))  # the mentions of one text
    lists = lists.withColumnsRenamed({"id": "__id", "text_key": "__key", "found": "__found"})
    rows = docs.withColumn("__text_key", F.xxhash64(f"`{text}`")).alias("d")
    joined = rows.join(lists.alias("l"), F.col(f"d.`{id_col}`").cast("string").eqNullSafe(F.col("l.__id")) & (F.col("d.__text_key") == F.col("l.__key")), "left")

    def woven(gaps: Column) -> Column:
        # a part follows its gap, or a space within its mention
        pieces = F.transform(F.col("__found"), lambda x: F.concat(F.when(x["part"] == 0, F.get(gaps, x["pos"])).otherwise(F.lit(" ")), x["new"]))
        return F.concat(F.array_join(pieces, ""), F.get(gaps, F.size(gaps) - 1))

    new = F.when(F.col("__found").isNull(), body).otherwise(let(F.split(body, f"({ANY})"), woven))
    found = F.coalesce(F.size(F.array_distinct(F.transform("__found", lambda x: x["pos"]))), F.lit(0)).cast("long")
    shown = joined.withColumn("__new", new).withColumn("__n", found)
    return shown.select(*[F.col("__new").alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns if c != count], F.col("__n").alias(count))
