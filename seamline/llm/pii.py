"""Keyed surrogates for personal data, in DataFrame functions only.

Detected entities: e-mail addresses, phone and card numbers, social security
and bank account numbers, IP addresses, hexadecimal secrets, access keys by
their beginnings, and persons after a title; in a text with "Ms Ann Lee" also
"Ann Lee" alone. An entity is a kind and a canonical form (case, separators and
a phone's country code apart), so every mention of one gets one replacement in
the whole corpus; persons are split into given and family name, so that
"Dr Ann Lee" and "Dr Lee" stay together. Names without a title anywhere in
their text, and scripts without capitals, are not detected.

A replacement is a hash of key, kind, form and attempt, shaped like the
original: digits in the mention's own separators with the country code kept and
a valid Luhn digit where the original has one, letters for letters, a secret or a name in
upper case where the mention is, an address
under example.com/org/net with the capitals of the local part, names of the
gender that the titles of a given name agree in, in the mention's script.
Collision checks over the whole entity table: of entities with equal
replacements the least form keeps it, none may equal a real form of its kind or
a settled replacement, and the others try again with the next attempt.

Texts are keyed by their digest, so copies are worked out once. Kinds with a
thousandth of all mentions or more are at most a thousand and are sent to all
tasks; the rest is joined. Null and empty texts, and texts without entities,
pass unchanged; an empty table gives no rows; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.shared import written



def _cased(titles: str) -> str:
    """The titles as they are and in upper case."""
    return f"{titles}|{titles.upper()}"


MALE = _cased("Mr|Herr|Señor|Monsieur|Signor|г-н|Господин|Κύριος") + "|ΚΥΡΙΟΣ"
FEMALE = _cased("Mrs|Ms|Miss|Sra|Srta|Frau|Señora|Madame|Signora|г-жа|Госпожа|Κυρία") + "|ΚΥΡΙΑ"
ANY = _cased("Dr|Prof|Mx|Доктор")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NAME = r"\p{Lu}[\p{L}'-]+"
#: Repetitions of groups are bounded everywhere: a matcher recurses on them.
EMAIL = r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]{0,63}[0-9])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![0-9A-Za-z])"
#: Access keys by their fixed beginnings.
TOKEN = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2} ?[0-9A-Z]{4}(?: ?\d{4}){2,6}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
#: National numbers without brackets: one separator throughout; between spaces only where area and exchange could be dialled.
NATIONAL = r"\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4}"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)" + rf"|(?<![\d+])(?<!\d\d[ .-])(?<![02-9][.-])(?:{NATIONAL})(?![ .-]?\d)" + r"|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![ .-]?\d)"
CARD = r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: The look ahead fails at once at most places of a text.
PERSON = rf"(?=[DFHMPSKΚгГД])(?<!\p{{L}})(?:{MALE}|{FEMALE}|{ANY})\.? {NAME}(?: {NAME})?"
PATTERN = f"(?:{EMAIL}|{TOKEN}|{IBAN}|{SECRET}|{IPV6}|{IP}|{PHONE}|{CARD}|{SSN}|{PERSON})"

#: Syllables of invented names by script.
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "ta", "ve", "wi", "ka", "mo", "pe", "du"],
    "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "та", "ве", "ви", "ка", "мо", "пе", "ду"],
    "greek": ["βα", "δε", "φι", "γο", "λυ", "μα", "νε", "ρι", "σο", "τα", "βε", "πι", "κα", "μο", "πε", "δυ"],
}
#: Endings by script and gender; family names have none.
ENDINGS = {"latin": {"m": "n", "f": "na", "x": "l"}, "cyrillic": {"m": "н", "f": "на", "x": "ль"}, "greek": {"m": "ς", "f": "να", "x": "λ"}}
#: A country code stays in the text, so it stays in a number's form and surrogate too.
COUNTRY = r"^(\+\d{1,3})(?=[ .(-])"
MAX_ATTEMPTS = 24
HOT_SHARE = 1000


def has_entity(text: Column) -> Column:
    """Whether ``PATTERN`` is found; a text without @ or digits is spared the costly parts, which need one."""
    numbers = "|".join((TOKEN, IBAN, SECRET, IPV6, IP, PHONE, CARD, SSN))
    return F.coalesce((text.contains("@") & text.rlike(EMAIL)) | (text.rlike("[0-9]") & text.rlike(numbers)) | text.rlike(PERSON), F.lit(False))


def _bytes(h: Column, i) -> Column:
    """Byte ``i`` (from 0, modulo 32) of a hex digest, as an integer."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(h, F.pmod(i, F.lit(32)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(key + "|"), F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)), 256)


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))


def _like(s: Column, h: Column) -> Column:
    """Letters for letters and digits for digits of ``s``, drawn from the digest."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def one(i: Column) -> Column:
        c, b = F.substring(s, i, F.lit(1)), _bytes(h, i)
        return F.when(c.rlike("[a-z]"), F.substring(F.lit(letters), F.pmod(b, F.lit(26)) + 1, F.lit(1))).when(c.rlike("[A-Z]"), F.substring(F.lit(letters.upper()), F.pmod(b, F.lit(26)) + 1, F.lit(1))).when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number's digits, the last one not doubled."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), part), F.lit(0), lambda a, b: a + b)


def _name(h: Column, script: str, ending: Column, attempt: Column) -> Column:
    syl = F.array(*[F.lit(x) for x in SYLLABLES[script]])
    # longer with every second attempt, so that a corpus never runs out of names
    parts = F.transform(F.sequence(F.lit(0), F.lit(2) + F.floor(attempt / 2).cast("int")), lambda i: F.element_at(syl, F.pmod(_bytes(h, i), F.lit(16)) + 1))
    return F.initcap(F.concat(F.array_join(parts, ""), ending))


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike(f"^(?:{TOKEN})$"), "token").when(m.rlike(f"^(?:{IBAN})$"), "iban").when(m.rlike(f"^(?:{IPV6})$"), "ipv6").when(m.rlike(f"^(?:{IP})$"), "ip").when(m.rlike(f"^(?:{CARD})$"), "card").when(m.rlike(f"^(?:{SSN})$"), "ssn")
        .when(m.rlike(rf"^[+(]|^(?:{NATIONAL})$"), "phone").when(m.rlike(r"^[0-9A-Fa-f]+$"), "secret").otherwise("person")
    )


def _parts(m: Column) -> Column:
    """The entities in a mention: an array of (kind, form, gender); a person may have two, and a given name has its title's gender (null: none)."""
    kind = _kind(m)
    digits = F.regexp_replace(m, "[^0-9]", "")
    bare = F.regexp_replace(m, rf"^(?:{MALE}|{FEMALE}|{ANY})\.? ", "")
    words = F.split(bare, " ")
    gender = F.when(m.rlike(f"^(?:{FEMALE})\\.? "), "f").when(m.rlike(f"^(?:{MALE})\\.? "), "m")
    script = F.when(m.rlike(r"\p{IsCyrillic}+.* ") & bare.rlike(r"\p{IsCyrillic}"), "cyrillic").when(bare.rlike(r"\p{IsCyrillic}"), "cyrillic").when(bare.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    pair = lambda k, f, g=F.lit(None).cast("string"): F.struct(k.alias("kind"), f.alias("form"), g.alias("gender"))
    family = pair(F.concat(F.lit("family|"), script), F.lower(F.element_at(words, -1)))
    given = pair(F.concat(F.lit("given|"), script), F.lower(words[0]), gender)
    # with and without its country code a number is one entity
    phone = F.substring(digits, F.greatest(F.length(F.regexp_extract(m, COUNTRY, 1)), F.lit(1)), F.length(digits))
    single = F.when(kind.isin("email", "secret", "ipv6"), F.lower(m)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).otherwise(m)
    return F.when((kind == "person") & (F.size(words) > 1), F.array(given, family)).when(kind == "person", F.array(family)).otherwise(F.array(pair(kind, single)))


def _proposal(key: str) -> Column:
    """The surrogate of columns kind, form, gender, attempt."""
    kind, form, attempt = F.col("kind"), F.col("form"), F.col("attempt")
    h = _digest(key, kind, form, attempt.cast("string"))
    local = F.substring_index(form, "@", 1)
    domain = F.concat(F.lit("mail"), F.pmod(_bytes(h, 30), F.lit(100)).cast("string"), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "org", "net"))), F.pmod(_bytes(h, 31), F.lit(3)) + 1))
    # an attempt too many for a short local part makes it longer
    longer = F.when(attempt > 3, F.pmod(_bytes(h, 29), F.lit(100)).cast("string")).otherwise("")
    email = F.concat(_like(local, h), longer, F.lit("@"), domain)
    number = _like(form, h)
    stem = F.substring(number, F.lit(1), F.length(number) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(stem, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn_sum(form), F.lit(10)) == 0, F.concat(stem, check)).otherwise(number)
    # what marks a token or a bank account stays: its beginning, and the country
    head = F.when(kind == "iban", F.substring(form, 1, 2)).otherwise(F.regexp_extract(form, "^(?:AKIA|gh._|sk-)", 0))
    marked = F.concat(head, _like(F.substring(form, F.length(head) + 1, F.length(form)), h))
    ipv6 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(h, i * 4 + 1, F.lit(4))), ":")
    ip = F.concat_ws(".", F.pmod(_bytes(h, 0), F.lit(223)) + 1, _bytes(h, 1), _bytes(h, 2), F.pmod(_bytes(h, 3), F.lit(254)) + 1)
    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "ssn", number).when(kind == "phone", number).when(kind.isin("token", "iban"), marked).when(kind == "ipv6", ipv6).when(kind == "ip", ip).when(kind == "secret", F.substring(F.concat(h, F.sha2(h, 256)), F.lit(1), F.length(form)))
    for script, ends in ENDINGS.items():
        last = F.when(kind.startswith("family"), "").otherwise(F.coalesce(*[F.when(F.col("gender") == g, end) for g, end in ends.items()], F.lit(ends["x"])))
        one = _name(h, script, last, attempt)
        # a double name stays one
        both = F.concat_ws("-", _name(F.sha2(h, 256), script, F.lit(""), attempt), one)
        out = out.when(kind.isin(f"family|{script}", f"given|{script}"), F.when(form.contains("-"), both).otherwise(one))
    return out


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for distinct entities (kind, form, and gender of given names where it is known), without collisions."""
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(None).cast("string"))
    real = entities.select("kind", F.col("form").alias("_s"))
    # the hashing costs far more than the bytes tell, so the rows are dealt out by number, not by size
    spread = 2 * entities.sparkSession.sparkContext.defaultParallelism
    open_, settled = entities.select("kind", "form", "gender").repartition(spread, "kind", "form"), None
    for attempt in range(MAX_ATTEMPTS):
        tried = open_.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", _proposal(key)).withColumn("_s", F.lower("surrogate"))
        tried = tried.join(real.withColumn("_taken", F.lit(True)), ["kind", "_s"], "left")
        if settled is not None:
            tried = tried.join(settled.select("kind", F.lower("surrogate").alias("_s"), F.lit(True).alias("_used")), ["kind", "_s"], "left")
        else:
            tried = tried.withColumn("_used", F.lit(None).cast("boolean"))
        free = F.col("_taken").isNull() & F.col("_used").isNull()
        best = tried.where(free).groupBy("kind", "_s").agg(F.min("form").alias("form"), F.lit(True).alias("_won"))
        tried = written(tried.join(best, ["kind", "_s", "form"], "left").select("kind", "form", "gender", "surrogate", "_won"), "surrogates")
        won = tried.where("_won").select("kind", "form", "surrogate")
        settled = won if settled is None else settled.unionByName(won)
        open_ = tried.where("_won IS NULL").select("kind", "form", "gender")
        if open_.isEmpty():
            return settled
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def _applied(m: Column, kinds: Column, surrogates: Column) -> Column:
    """The text that replaces mention ``m``."""
    first = surrogates[0]
    code = F.greatest(F.length(F.regexp_extract(m, COUNTRY, 1)) - 1, F.lit(0))
    drawn = F.concat(F.repeat(F.lit("0"), code), F.regexp_replace(first, "[^0-9]", ""))  # a country code's digits are not drawn

    def digit(i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        k = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]") & (i > F.length(F.regexp_extract(m, COUNTRY, 1))), F.substring(drawn, k, F.lit(1))).otherwise(c)

    title = F.regexp_extract(m, rf"^((?:{MALE}|{FEMALE}|{ANY})\.? )", 1)
    names = F.array_join(surrogates, " ")
    upper = ~F.substring(m, F.length(title) + 1, F.length(m)).rlike(r"\p{Ll}")
    numbers = F.array_join(F.transform(_chars(m), digit), "")
    local = F.length(F.substring_index(m, "@", 1))
    address = F.array_join(F.transform(_chars(first), lambda i: F.when((i <= local) & F.substring(m, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substring(first, i, F.lit(1)))).otherwise(F.substring(first, i, F.lit(1)))), "")
    spaced = F.array_join(F.transform(_chars(m), lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", " ").otherwise(F.substring(first, i - F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^ ]", "")), F.lit(1)))), "")
    return F.when(kinds[0].isin("card", "ssn", "phone"), numbers).when(kinds[0] == "email", F.when(m.rlike("[A-Z]"), address).otherwise(first)).when(kinds[0] == "iban", spaced).when(kinds[0].rlike("[|]"), F.concat(title, F.when(upper, F.upper(names)).otherwise(names))).when((kinds[0] == "secret") & m.rlike("[A-F]") & ~m.rlike("[a-f]"), F.upper(first)).otherwise(first)


def _untitled(m: Column, kinds: Column) -> Column:
    """Given and family name of a person's mention without the title; empty for anything else."""
    bare = F.regexp_replace(m, rf"^(?:{MALE}|{FEMALE}|{ANY})\.? ", "")
    return F.when((F.size(kinds) == 2) & bare.contains(" "), bare).otherwise("")


def surrogate(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the entities of column ``text`` replaced; all columns kept, none added."""
    found = has_entity(F.col("text"))
    digest = F.md5(F.encode("text", "utf-8"))
    mentions = docs.where(found).select(digest.alias("k"), F.expr("regexp_extract_all(text, '" + PATTERN.replace("\\", "\\\\").replace("'", "\\'") + "', 0)").alias("ms"))
    texts = mentions.groupBy("k").agg(F.first("ms").alias("ms"))
    rows = texts.select("k", F.posexplode("ms").alias("pos", "m")).select("k", "pos", "m", F.posexplode(_parts(F.col("m"))).alias("part", "e")).select("k", "pos", "m", "part", "e.kind", "e.form", "e.gender")
    rows = written(rows, "mentions")

    # a given name has the gender of all its titles, or none where they differ
    gender = F.when(F.min("gender") == F.max("gender"), F.min("gender"))
    counted = written(rows.groupBy("kind", "form").agg(F.count("*").alias("n"), gender.alias("gender")), "entities")
    mapped = written(assign_surrogates(counted, key).join(counted.drop("gender"), ["kind", "form"]), "mapped")
    total = rows.count()
    hot = mapped.where(F.col("n") > max(HOT_SHARE, total // HOT_SHARE)).select("kind", "form", F.col("surrogate").alias("_hot"))
    cold = mapped.where(F.col("n") <= max(HOT_SHARE, total // HOT_SHARE)).select("kind", "form", "surrogate")
    got = rows.join(F.broadcast(hot), ["kind", "form"], "left")  # HOT_SHARE rows at most
    is_hot = F.col("_hot").isNotNull()
    got = got.where(is_hot).withColumnRenamed("_hot", "surrogate").unionByName(got.where(~is_hot).drop("_hot").join(cold, ["kind", "form"]))

    per = got.groupBy("k", "pos").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("part", "kind", "surrogate"))).alias("x"))
    new = per.select("k", "pos", _applied(F.col("m"), F.col("x.kind"), F.col("x.surrogate")).alias("r"), _untitled(F.col("m"), F.col("x.kind")).alias("name"), F.array_join("x.surrogate", " ").alias("names"))
    known = F.collect_set(F.when(F.col("name") != "", F.struct("name", "names")))
    replaced = new.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("_r"), F.array_sort(known).alias("_n")).select("k", F.col("_r.r").alias("_r"), "_n")

    gaps = F.split("text", PATTERN, -1)
    # a full name that a titled mention gives is replaced without its title too, between the mentions
    bare = lambda g: F.aggregate("_n", g, lambda t, p: F.when(F.contains(t, p["name"]), F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'-])"), p["name"], F.lit(r"(?![\p{L}'-])")), p["names"])).otherwise(t))
    text = F.array_join(F.zip_with(gaps, F.array_append("_r", F.lit("")), lambda g, r: F.concat(bare(g), r)), "")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    changed = docs.where(found).select(F.struct(*columns).alias("_row"), "text", digest.alias("_k"))
    changed = changed.join(replaced.withColumnRenamed("k", "_k"), "_k")
    changed = changed.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return docs.where(~found).unionByName(changed)
