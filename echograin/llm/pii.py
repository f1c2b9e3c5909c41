"""Personal data: keyed surrogates in place of detected entities.

Entities (e-mail, phone, IPv4 and IPv6 address, payment card with a valid check digit, social-security number, IBAN,
secret, titled personal name) are found by one pattern. An entity's normal form (case, spacing and punctuation taken
out) and the key give a SHA-256 stream, and the stream gives the surrogate: letters for letters, digits for digits, the
same length and punctuation, cards and IBANs with right check digits, addresses with right octets, names of the title's
gender, of the same script, case and number of hyphenated parts. So one entity has one surrogate in all documents,
however it is written.

Names are replaced part by part, given names and family names each by their own surrogate, so "Mrs. Anna Smith", "Anna
Smith" and "Smith" stay one person. Once a title has shown a name, the whole name and its parts are replaced throughout
that text, with or without the title; other texts' untitled names are not looked for.

Collision checks keep different entities different: over the distinct entities of the corpus, a surrogate is given to
the smallest normal form that asks for it, unless it is itself an entity of the corpus; the others ask again with the
next stream, which draws from a wider space (a syllable, a group or more characters longer; where the format fixes the
length, as with phone numbers and cards, from the same one), until none is left. After ``ROUNDS`` rounds, when a format
has nearly as many entities as it has surrogates, the job ends with an error. The rounds run on distinct entities,
partial aggregates before every shuffle, and only the texts that hold entities meet the mapping, in a join on a key of
their own (a text that repeats very often is split by Spark's skew join; its mapping is one row).

Only DataFrame functions are used. Defined cases: null and empty texts stay as they are, with 0 replaced; equal rows
get equal results and stay as many; an empty table gives an empty result; other columns are carried along unchanged,
and the count's column takes underscores until its name is free; a text of any length is read whole. Names of scripts
without a pool get Latin surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

KEY = "surrogate-key-1"

#: Rounds of collision checks before the job gives up.
ROUNDS = 40

# Titles by gender ("n": none told) and script, given names, syllables.
TITLES = {
    "m": "Mr|Mister|Herr|Herrn|Monsieur|Sr|Señor|г-н|господин|κύριος|κος",
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Sra|Srta|Señora|г-жа|госпожа|κυρία|κα",
    "n": "Dr|Doctor|Prof|Professor|Doktor|Docteur|доктор|профессор|δρ",
}
GIVEN = {
    ("m", "latin"): "Adam Ben Carl David Erik Felix Georg Henry Ivan Jonas Karl Louis Marc Nils Oscar Paul".split(),
    ("f", "latin"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("n", "latin"): "Alex Andrea Ariel Charlie Chris Dominique Jamie Jules Kim Luca Maxime Nikita Robin Sam Sasha Toni".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Ирина Кира Лидия Мария Нина Ольга Полина Раиса София Тамара".split(),
    ("n", "cyrillic"): "Саша Женя Валя Шура Слава Паша Вася Юля".split(),
    ("m", "greek"): "Άγγελος Βασίλης Γιάννης Δημήτρης Ηλίας Θανάσης Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Στέφανος".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Λυδία Μαρία Νίκη Σοφία Χριστίνα".split(),
    ("n", "greek"): "Φώτη Χάρη Ρένο Λίνο".split(),
}
SYLLABLES = {
    "latin": "ba bel dor fan gar hol jen kam lin mor nas pel ras sol tan vel".split(),
    "cyrillic": "ба бел дор фан гар хол лин мор нас пел рас сол тан вел ков нов".split(),
    "greek": "βα γαρ δορ ζαν θελ καμ λιν μορ νε πελ ρα σολ ταν φαν χολ ψα".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: A part of a name: capitalized or all capitals, with its hyphenated or apostrophized parts.
_PART = r"(?:\p{Lu}\p{Ll}*(?:['’-]?\p{Lu}\p{Ll}+)+|\p{Lu}\p{Ll}+|\p{Lu}{2,}(?:-\p{Lu}{2,})*)"
_INITIAL = r"(?:\p{Lu}\. ){0,2}"
_KEYWORD = r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": rf"(?i:\b{_KEYWORD})\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9/+_-]{{12,}}|\bAKIA[0-9A-Z]{{16}}\b",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{3,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:{_HEX}(?::{_HEX}){{7}}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,4}})?)(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"(?<!\w)(?:{'|'.join(TITLES.values())})\.? {_PART}(?: {_INITIAL}{_PART})?(?!\w)",
}
ANY = "|".join(PATTERNS.values())


def may_hold(text: Column) -> Column:
    """Whether a text can hold an entity: every pattern but the names' needs one of a few characters. Null is none."""
    return F.coalesce((text.rlike("[0-9@=:]|AKIA") | text.rlike(PATTERNS["name"])) & text.rlike(ANY), F.lit(False))


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit at weight 1."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    one = lambda i: F.coalesce(F.substring(digits, n - i + 1, F.lit(1)).try_cast("int"), F.lit(0))
    return F.aggregate(at, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0)))


def kind_of(e: Column) -> Column:
    """Type of a string that the common pattern found; null where it proves to be none (a card's check digit is wrong)."""
    whole = lambda k: e.rlike(f"^(?:{PATTERNS[k]})$")
    card = whole("card") & (_luhn_sum(_digits(e)) % 10 == 0)
    kind = F.when(whole("email"), "email").when(whole("secret"), "secret").when(whole("phone"), "phone").when(whole("ip"), "ip").when(whole("ipv6"), "ipv6").when(whole("ssn"), "ssn").when(card, "card").when(whole("card"), None)
    return kind.when(whole("iban"), "iban").when(whole("name"), "name")


def _secret_value(e: Column) -> Column:
    return F.regexp_extract(e, r"([A-Za-z0-9/+_-]+)$", 1)


def normal(e: Column, kind: Column) -> Column:
    """Normal form of an entity that is no name."""
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(e))
        .when(kind.isin("phone", "ssn", "card"), _digits(e))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "secret", _secret_value(e))
        .otherwise(e)
    )


def _stream(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    seed = F.concat_ws("|", kind, norm, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}|{k}|"), seed), 256) for k in range(2)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shape(value: Column, stream: Column, hexadecimal: Column | bool = False, keep: int = 0) -> Column:
    """Letters for letters and digits for digits; the first ``keep`` characters stay."""
    pick = lambda alphabet, b: F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(i: Column) -> Column:
        c, b = F.substring(value, i + 1, F.lit(1)), _byte(stream, i)
        hexa = F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal
        return F.when(i < keep, c).when(hexa & c.rlike("[0-9a-f]"), pick("0123456789abcdef", b)).when(c.rlike("[0-9]"), pick(digit, b)).when(c.rlike("[a-z]"), pick(lower, b)).when(c.rlike("[A-Z]"), pick(upper, b)).otherwise(c)

    return F.when(F.length(value) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(value) - 1, F.lit(0))), one), "")).otherwise(value)


def _chosen(pool: list[str], b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), b % len(pool) + 1)


def _syllables(script: str, stream: Column, first: Column | int, n: Column) -> Column:
    at = F.sequence(F.lit(first) if isinstance(first, int) else first, (F.lit(first) if isinstance(first, int) else first) + n - 1)
    return F.when(n > 0, F.array_join(F.transform(at, lambda i: _chosen(SYLLABLES[script], _byte(stream, i))), "")).otherwise("")


def _by_script(body: Column, of) -> Column:
    return F.when(body.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(body.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _given_name(norm: Column, stream: Column, attempt: Column) -> Column:
    """norm: gender, colon, name. A name of the pool, longer by a syllable with each attempt."""
    pool = lambda g, script: F.lower(_chosen(GIVEN[g, script], _byte(stream, F.lit(0))))
    one = lambda script: F.concat(F.when(norm.startswith("f"), pool("f", script)).when(norm.startswith("m"), pool("m", script)).otherwise(pool("n", script)), _syllables(script, stream, 1, attempt))
    return _by_script(norm, one)


def _family_name(norm: Column, stream: Column, attempt: Column) -> Column:
    """As many hyphenated parts as the name has, four syllables in the first, two in others, one more each attempt."""
    parts = F.split(norm, "-")
    one = lambda script: F.array_join(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: _syllables(script, stream, k * 20, F.when(k == 0, 4).otherwise(2) + attempt)), "-")
    return _by_script(norm, one)


def _iban(norm: Column, stream: Column) -> Column:
    """Country and form of ``norm`` with new characters and right check digits (ISO 7064, 97-10)."""
    body = _shape(F.substring(norm, 5, 1000), stream)
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    whole = F.split(F.concat(body, F.substring(norm, 1, 2), F.lit("00")), "")
    rest = F.aggregate(F.filter(whole, lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(F.substring(norm, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _hex_groups(stream: Column, n: int) -> Column:
    return F.concat_ws(":", *[F.substring(F.reverse(stream), 4 * k + 1, 4) for k in range(n)])


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form; later attempts draw from a wider space where the format lets them."""
    s = _stream(kind, norm, attempt, key)
    wider = F.when(attempt > 0, F.translate(F.substring(F.reverse(s), F.lit(1), attempt * 2), "0123456789", "ghijklmnop")).otherwise("")
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    email = F.concat(_shape(local, s), wider, F.lit("@"), _shape(F.substring_index(domain, ".", 1), F.reverse(s)), F.lit(".example."), F.substring_index(domain, ".", -1))
    octets = F.concat_ws(".", *[_byte(s, F.lit(k)) % 254 + 1 for k in range(4)])
    ipv6 = F.when(attempt == 0, _shape(norm, s, True)).otherwise(F.concat(F.lit("2001:db8:"), _hex_groups(s, 6)))
    country = F.greatest(F.length(norm) - 10, F.lit(0))
    phone = F.concat(F.substring(norm, F.lit(1), country), _shape(F.substring(norm, country + 1, F.lit(10)), s))
    payload = _shape(F.substring(norm, F.lit(1), F.length(norm) - 1), s, keep=1)
    card = F.concat(payload, ((10 - _luhn_sum(F.concat(payload, F.lit("0"))) % 10) % 10).cast("string"))
    # A later attempt's secret is of letters and digits all through: one of punctuation alone would never change.
    solid = _shape(F.regexp_replace(norm, "[^A-Za-z0-9]", "x"), s)
    secret = F.when(norm.rlike("^AKIA"), _shape(norm, s, keep=4)).when(attempt > 0, solid).otherwise(_shape(norm, s, norm.rlike("^[0-9a-f]+$")))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind == "ipv6", ipv6)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "secret", secret)
        .when(kind == "iban", _iban(norm, s))
        .when(kind == "given", _given_name(norm, s, attempt))
        .when(kind == "family", _family_name(norm, s, attempt))
        .otherwise(_shape(norm, s))
    )


def written(e: Column, kind: Column, given: Column) -> Column:
    """The surrogate in the form in which the entity ``e`` is written."""
    alnum = lambda x: F.length(F.regexp_replace(x, "[^0-9A-Za-z]", ""))

    def one(i: Column) -> Column:
        c = F.substring(e, i, F.lit(1))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(given, alnum(F.substring(e, F.lit(1), i)), F.lit(1))).otherwise(c)

    formatted = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(e), F.lit(1))), one), "")
    secret = F.concat(F.substring(e, F.lit(1), F.length(e) - F.length(_secret_value(e))), given)
    return F.when(kind.isin("phone", "card", "iban", "ssn"), formatted).when(kind == "secret", secret).otherwise(given)


def name_forms(e: Column) -> Column:
    """What a titled name shows up as in its text: the name with title, without it, and its parts.

    An array of structs: form, prefix, given (null if it has none), middle, family (null where only the given name is
    meant) and gender.
    """
    title = rf"^((?:{'|'.join(TITLES.values())})\.? )"
    prefix, body = F.regexp_extract(e, title, 1), F.regexp_replace(e, title, "")
    two = rf"^({_PART}) ({_INITIAL})({_PART})$"
    part = lambda k: F.regexp_extract(body, two, k)
    told = lambda g: e.rlike(f"^(?:{TITLES[g]})\\.? ")
    gender = F.when(told("m"), "m").when(told("f"), "f").otherwise("n")
    none = F.lit(None).cast("string")
    form = lambda f, p, g, m, n: F.struct(f.alias("form"), p.alias("prefix"), g.alias("given"), m.alias("middle"), n.alias("family"), gender.alias("gender"))
    empty = F.lit("")
    long = F.array(form(e, prefix, part(1), part(2), part(3)), form(body, empty, part(1), part(2), part(3)), form(part(3), empty, none, empty, part(3)), form(part(1), empty, part(1), empty, none))
    return F.when(body.rlike(two), long).otherwise(F.array(form(e, prefix, none, empty, body), form(body, empty, none, empty, body)))


def _cased(given: Column, like: Column) -> Column:
    """A surrogate part in the case of what it replaces."""
    title = F.array_join(F.transform(F.split(given, "-"), lambda x: F.initcap(x)), "-")
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(given)).otherwise(title)


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, norm, given for the distinct rows (kind, norm) of ``entities``: collision-free surrogates."""
    # Few bytes but long expressions: a stated number of partitions keeps them from being put together in one task.
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = materialize(entities.select("kind", "norm").distinct().repartition(parts, "kind", "norm"), "pii-entities")
    asked = materialize(names.withColumn("attempt", F.lit(0)).withColumn("given", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "pii-asked")
    held = None
    for _ in range(ROUNDS):
        winners = asked.groupBy("kind", "given").agg(F.min("norm").alias("norm"))
        free = winners.join(names.withColumnRenamed("norm", "given"), ["kind", "given"], "left_anti")
        if held is not None:
            free = free.join(held.select("kind", "given"), ["kind", "given"], "left_anti")
        settled = materialize(free.select("kind", "norm", "given"), "pii-settled")
        held = settled if held is None else held.unionByName(settled)
        again = asked.join(settled.select("kind", "norm"), ["kind", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        last, asked = asked, materialize(again.withColumn("given", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "pii-asked")
        release(last)
        if asked.isEmpty():
            release(asked, names)
            return held
    raise RuntimeError(f"{asked.count()} entities have no surrogate of their own after {ROUNDS} rounds, for instance {asked.select('kind').first().kind}")


_ALONE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def replace(docs: DataFrame, text: str = "text", key: str = KEY, count: str = "n_replaced") -> DataFrame:
    """``docs`` with surrogates in ``text`` and, as the last column, the number of entities replaced.

    The last column is named ``count``, with underscores behind it if ``docs`` has such a column.
    """
    while count in docs.columns:
        count += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    clean = docs.where(~may_hold(F.col(text))).select(*columns, F.lit(0).cast("long").alias(count))
    body = F.col("row")[text]
    dirty = docs.where(may_hold(F.col(text))).select(F.struct(*columns).alias("row"), found.alias("entities"))
    # Once a title has shown a name, its forms are looked for in the whole text: they join the pattern, longest first.
    names = F.filter(F.array_distinct("entities"), lambda e: e.rlike(f"^(?:{PATTERNS['name']})$"))
    forms = F.array_distinct(F.flatten(F.transform(names, lambda e: F.transform(F.slice(name_forms(e), 2, 3), lambda f: f["form"]))))
    dirty = dirty.withColumn("forms", F.sort_array(F.transform(forms, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f")))))
    pattern = F.when(F.size("forms") > 0, F.concat(F.lit(f"{ANY}|{_ALONE[0]}(?:"), F.array_join(F.transform("forms", lambda x: x["f"]), "|"), F.lit(f"){_ALONE[1]}"))).otherwise(F.lit(ANY))
    dirty = dirty.withColumn("pattern", pattern).withColumn("spans", F.when(F.size("forms") > 0, F.regexp_extract_all(body, F.col("pattern"), F.lit(0))).otherwise(F.col("entities")))
    dirty = dirty.withColumn("own", F.md5(F.concat_ws("\x1f", F.size("spans").cast("string"), body).cast("binary")))
    dirty = materialize(dirty.select("row", "own", "entities", "pattern", "spans"), "pii-texts")
    each = dirty.select("own", F.explode(F.array_distinct("entities")).alias("e")).distinct().withColumn("kind", kind_of(F.col("e"))).where(F.col("kind").isNotNull())
    each = materialize(each.withColumn("norm", normal(F.col("e"), F.col("kind"))), "pii-each")
    people = each.where("kind = 'name'").select("own", F.explode(name_forms(F.col("e"))).alias("f")).select("own", "f.*")
    people = people.groupBy("own", "form").agg(*[F.min(c).alias(c) for c in ("prefix", "given", "middle", "family", "gender")])
    given_norm, family_norm = F.concat_ws(":", "gender", F.lower("given")), F.lower("family")
    people = materialize(people.withColumns({"g": F.when(F.col("given").isNotNull(), given_norm), "f": family_norm}), "pii-names")
    kinds = people.select(F.explode(F.array(F.struct(F.lit("given").alias("kind"), F.col("g").alias("norm")), F.struct(F.lit("family").alias("kind"), F.col("f").alias("norm")))).alias("x")).select("x.*")
    given = materialize(assign(each.where("kind <> 'name'").select("kind", "norm").unionByName(kinds.where("norm IS NOT NULL")), key), "pii-given")
    plain = each.where("kind <> 'name'").join(given, ["kind", "norm"]).select("own", "e", written(F.col("e"), F.col("kind"), F.col("given")).alias("into"))
    part = lambda kind, at: given.where(F.col("kind") == kind).select(F.col("norm").alias(at), F.col("given").alias(f"{at}_to"))
    named = people.join(part("given", "g"), "g", "left").join(part("family", "f"), "f", "left")
    whole = F.concat(F.col("prefix"), F.concat_ws(" ", _cased(F.col("g_to"), F.col("given")), F.when(F.col("family").isNotNull(), F.concat("middle", _cased(F.col("f_to"), F.col("family"))))))
    pairs = plain.unionByName(named.select("own", F.col("form").alias("e"), whole.alias("into")))
    maps = pairs.groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct("e", "into"))).alias("into"))
    wide = dirty.join(maps, "own", "left").withColumn("parts", F.split(body, F.col("pattern"), -1))
    swap = F.transform("spans", lambda e: F.coalesce(F.try_element_at(F.col("into"), e), e))
    pieces = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat(F.element_at("parts", i), F.coalesce(F.try_element_at(F.col("swapped"), i), F.lit(""))))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, e: s + F.when(F.map_contains_key(F.col("into"), e), 1).otherwise(0))
    n = F.when(F.col("into").isNull(), F.lit(0).cast("long")).otherwise(n)
    # A union of the two halves: rows without entities never move.
    done = wide.withColumn("swapped", swap).select(*[(F.array_join(pieces, "").alias(text) if c == text else F.col(f"row.`{c}`").alias(c)) for c in docs.columns], n.alias(count))
    return clean.unionByName(done)
