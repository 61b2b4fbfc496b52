"""Text normalisation, parsing of labels and pages, and small string functions, as Columns."""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(s: Column) -> Column:
    """Lower case, anything but a-z as one space, a space at either end."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z ]+", " "), " +", " "))
    return F.concat(F.lit(" "), t, F.lit(" "))


def has(t: Column, *prefixes: str) -> Column:
    """Whether a word of ``tokens`` output starts with one of the prefixes."""
    c = F.lit(False)
    for p in prefixes:
        c |= t.contains(" " + p)
    return c


def hand(raw: Column) -> Column:
    t = tokens(raw)
    left, right = has(t, "left"), has(t, "right")
    return F.when(left & ~right, "LHB").when(right & ~left, "RHB")


#: Word beginnings that name a bowling family, an arm or pace, and phrases that say a player does not bowl.
DECLINES = ["does not bowl", "doesnt bowl", "none", "non bowler", "no bowling"]
UNORTHODOX = ["unorthodox", "chinaman", "wrist"]
ORTHODOX = ["orthodox"]
OFF = ["off break", "offbreak", "off spin", "offspin", "offbreaks", "off cutter"]
LEG = ["leg break", "legbreak", "leg spin", "legspin", "legbreaks", "googly"]
FAST = ["fast", "medium", "pace", "seam", "swing", "quick"]


def bowl_class(raw: Column) -> Column:
    """One of RAP, LAP, OB, LB, SLA, SLW, or null: a stated arm overrides the family's own, pace needs one, mixed families give none."""
    t = tokens(raw)
    left, right = has(t, "left"), has(t, "right")
    only_left, only_right = left & ~right, right & ~left
    family = [has(t, *words) for words in (UNORTHODOX, LEG, OFF, ORTHODOX)]
    unorthodox, leg, off, orthodox = family
    pace, n = has(t, *FAST), sum((c.cast("int") for c in family), F.lit(0))
    wrist, finger = F.when(only_right, "LB").otherwise("SLW"), F.when(only_right, "OB").otherwise("SLA")
    spin = F.when(unorthodox, wrist).when(leg, F.when(only_left, "SLW").otherwise("LB")).when(off, F.when(only_left, "SLA").otherwise("OB")).when(orthodox, finger)
    return F.when(has(t, *DECLINES) | (n > 1) | ((n == 1) & pace), None).when(pace, F.when(only_left, "LAP").when(only_right, "RAP")).otherwise(spin)


def edition_year(first_date: Column) -> Column:
    return F.substring(first_date, 1, 4).cast("int")


def date_int(date: Column) -> Column:
    """YYYYMMDD of a zero-padded ISO date; anything else is null."""
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.regexp_replace(date, "-", "").cast("int"))


def stage(value: Column) -> Column:
    """A stage that may be text or a number, read as a string; absent or null is empty."""
    return F.coalesce(F.nullif(value, F.lit("null")), F.lit(""))


def ball_label(label: Column) -> tuple[Column, Column]:
    """(over, ball from 0) of "17.4"; nulls where the label is no such pair."""
    ok = label.rlike(r"^\d+\.\d+$")
    return F.when(ok, F.split_part(label, F.lit("."), F.lit(1)).cast("int")), F.when(ok, F.split_part(label, F.lit("."), F.lit(2)).cast("int") - 1)


def canonical(name: Column, aliases: dict[str, str], fold: bool = False) -> Column:
    """The name that an alias stands for, else the name itself; ``fold`` compares in lower case without outer spaces."""
    if not aliases:
        return name
    key = F.lower(F.trim(name)) if fold else name
    pairs = [F.lit(v) for k, x in aliases.items() for v in ((k.lower().strip() if fold else k), x)]
    return F.coalesce(F.create_map(*pairs)[key], name)


def short_team(name: Column, short: dict[str, str]) -> Column:
    """The team's abbreviation, else its initials in capitals."""
    initials = F.upper(F.array_join(F.transform(F.filter(F.split(name, " +"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))
    return F.coalesce(canonical(F.when(name.isin(list(short)), name), short), initials) if short else initials


def monogram(name: Column) -> Column:
    """First ASCII letters of the first and last words; of a single word its first two characters; a dash for none."""
    words = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    letter = lambda w: F.upper(F.regexp_extract(w, "([A-Za-z])", 1))
    return F.when(F.size(words) == 0, "—").when(F.size(words) == 1, F.upper(F.substring(words[0], 1, 2))).otherwise(F.concat(letter(F.element_at(words, 1)), letter(F.element_at(words, -1))))


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


def clean_player(name: Column) -> Column:
    """White space trimmed, cut at 24 bytes of UTF-8, only letters, digits, space, _ and - of ASCII, trimmed again."""
    # a byte a character, so that a character cut in two goes with the others that are not of ASCII
    cut = F.decode(F.substring(F.encode(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), "UTF-8"), 1, 24), "ISO-8859-1")
    return F.trim(F.regexp_replace(cut, r"[^A-Za-z0-9_\- ]", ""))


def intent(s: Column) -> Column:
    """block, rotate or attack from its name or first letter, rotate for empty; null for anything else."""
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    return F.when(t.isin("b", "block"), "block").when(t.isin("", "r", "rotate"), "rotate").when(t.isin("a", "attack"), "attack")


def situation_id(target: Column, venue: Column) -> Column:
    return F.format_string("free:%d:%d", target, venue)


def parse_situation(s: Column) -> tuple[Column, Column]:
    """(target, venue) of a situation id within bounds, else nulls."""
    t, v = (F.nullif(F.regexp_extract(s, r"^free:(\d{1,6}):(\d{1,6})$", i), F.lit("")).cast("int") for i in (1, 2))
    ok = t.between(172, 214) & v.between(0, 254)
    return F.when(ok, t), F.when(ok, v)


def clean_wikitext(s: Column) -> Column:
    """Drops comments, references, tags and bold; links become their labels before templates go; runs of white space become one space."""
    steps = [(r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>]*/>", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1"), (r"\{\{[^{}]*\}\}", ""), (r"<[^>]*>", ""), (r"'{2,}", ""), (r"\s+", " ")]
    for pattern, to in steps:
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def infobox_field(text: Column, name: str) -> Column:
    """The first value of ``| name = value`` on a line of its own; an empty value stays empty."""
    return F.regexp_extract(text, rf"(?im)^[ \t]*\|[ \t]*{re.escape(name)}[ \t]*=[ \t]*(.*?)[ \t]*$", 1)


LIST_TEMPLATES = ["ubl", "unbulleted list", "plainlist", "hlist", "flatlist"]


def expand_templates(s: Column, rounds: int = 8) -> Column:
    """Innermost templates first: list templates keep their positional arguments joined by ", ", others go.

    Each of at most ``rounds`` rounds settles the templates that hold no other.
    """
    inner = r"\{\{([^{}]*)\}\}"
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def shown(template: Column) -> Column:
        parts = F.split(template, r"\|")
        kept = F.filter(F.slice(parts, 2, F.size(parts)), lambda a: ~F.contains(a, F.lit("=")) & (bare(a) != ""))
        return F.when(F.lower(bare(parts[0])).isin(LIST_TEMPLATES), F.array_join(F.transform(kept, bare), ", ")).otherwise("")

    def settled(text: Column) -> Column:
        between, found = F.split(text, inner, -1), F.regexp_extract_all(text, F.lit(inner), F.lit(1))
        return F.array_join(F.zip_with(between, found, lambda t, m: F.concat(t, F.coalesce(shown(m), F.lit("")))), "")

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), s, lambda text, _: F.when(text.rlike(inner), settled(text)).otherwise(text))


_BLOCK = 64


def _padded(key: bytes | Column, pad: int) -> Column:
    """The key, hashed where it is longer than a block, filled up with zeros, each byte combined with ``pad``."""
    if isinstance(key, bytes):
        key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
        return F.lit(bytes(b ^ pad for b in key.ljust(_BLOCK, b"\0")))
    digits = F.rpad(F.when(F.octet_length(key) > _BLOCK, F.sha2(key, 256)).otherwise(F.hex(key)), 2 * _BLOCK, "0")
    words = [F.conv(F.substring(digits, i * 8 + 1, 8), 16, 10).cast("bigint").bitwiseXOR(F.lit(pad * 0x01010101)) for i in range(_BLOCK // 4)]
    return F.unhex(F.concat(*[F.lpad(F.hex(w), 8, "0") for w in words]))


def hmac_sha256(key: bytes | Column, message: Column) -> Column:
    """HMAC-SHA256 as binary; the key is the same for all rows, or a binary column. Null for a null key or message."""
    inner = F.unhex(F.sha2(F.concat(_padded(key, 0x36), message), 256))
    return F.unhex(F.sha2(F.concat(_padded(key, 0x5C), inner), 256))


def derive_key(secret: bytes, date: Column, size: int = 32) -> Column:
    """HKDF-SHA256 of a master secret with the date as context, as binary."""
    if not secret:
        raise ValueError("a secret is needed")
    prk = hmac.digest(b"\0" * 32, secret, "sha256")
    info = F.encode(F.concat(F.lit("seamline/"), date), "UTF-8")
    block, parts = None, []
    for i in range(-(-size // 32)):
        block = hmac_sha256(prk, F.concat(*([block] if parts else []), info, F.lit(bytes([i + 1]))))
        parts.append(block)
    return F.substring(F.concat(*parts), 1, size)


def run_token(secret: bytes | Column, run_id: Column, date: Column) -> Column:
    """URL-safe, without padding."""
    mac = hmac_sha256(secret, F.encode(F.concat_ws("|", run_id, date), "UTF-8"))
    return F.translate(F.rtrim(F.base64(mac), F.lit("=")), "+/", "-_")


def check_token(secret: bytes | Column, run_id: Column, date: Column, token: Column) -> Column:
    """Whether the token is that of the run. Both are hashed before they meet, so what a comparison's time tells is of no use."""
    return F.sha2(F.encode(run_token(secret, run_id, date), "UTF-8"), 256) == F.sha2(F.encode(F.coalesce(token, F.lit("")), "UTF-8"), 256)


def fnv1a(text: Column) -> Column:
    """The public 32-bit FNV-1a hash of the UTF-8 bytes, as a long."""
    digits = F.hex(F.encode(text, "utf-8"))
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(2166136261).cast("bigint"), lambda h, i: F.pmod(h.bitwiseXOR(byte(i)) * F.lit(16777619), F.lit(1 << 32)))


#: The least and the spread of each measure of a ground that has no data, and which bits of the hash give it.
GROUND = {"straight": (66, 11, 0), "square": (60, 9, 8), "capacity": (15000, 30000, 16), "tiers": (1, 3, 4)}


def stable_attributes(venue: Column) -> dict[str, Column]:
    """Measures that a venue's name alone decides, for those without data; and its name and city, apart at the last comma."""
    h = fnv1a(venue)
    out = {k: (F.lit(least) + F.pmod(F.shiftright(h, bits), F.lit(spread))).cast("int") for k, (least, spread, bits) in GROUND.items()}
    parts = F.regexp_extract(venue, "^(.+), (.*)$", 1), F.regexp_extract(venue, "^(.+), (.*)$", 2)
    return {"name": F.when(parts[0] != "", parts[0]).otherwise(venue), "city": parts[1], **out, "roof": F.when(F.pmod(F.shiftright(h, 12), F.lit(3)) == 1, "partial").otherwise("none"), "lights": F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, "pylons").otherwise("roof")}


def local_date(ts: Column) -> Column:
    """The date at UTC+05:30."""
    return F.date_format(F.expr("INTERVAL 330 MINUTES") + ts, "yyyy-MM-dd")


def share_text(date: Column, defend_grid: Column, chase_grid: Column, runs: Column, share: Column, streak: Column) -> Column:
    """Two grid lines, the day's percentage if there is more than one run, the streak if longer than one day."""
    boxes = lambda g: F.array_join(F.transform(F.split(g, ""), lambda c: F.when(c == "g", "+").when(c == "b", "-").otherwise("=")), "")
    return F.concat_ws("\n", date, boxes(defend_grid), boxes(chase_grid), F.when(runs > 1, F.concat(share.cast("string"), F.lit("% did both"))), F.when(streak > 1, F.concat(F.lit("streak "), streak.cast("string"))))
