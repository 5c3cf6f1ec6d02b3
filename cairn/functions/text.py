"""Names, labels and page text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.geo import col

# Accented letters and the plain ones they fold to.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçāăąēĕėęěīĭįōŏőūŭůűųćĉċčďĝğġģĥķĺļľńņňŕŗřśŝşšţťŵŷźżž"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncaaaeeeeeiiiooouuuuuccccdgggghklllnnnrrrssssttwyzzz"
# Words that name a kind of building, by kind; listing types that are no building.
HUT_WORDS = ["rifugio", "baita", "capanna", "chalet", "casera"]
BIVOUAC_WORDS = ["bivacco", "bivouac"]
OTHER_LODGING_WORDS = ["ostello", "albergo", "hotel", "agriturismo", "parcheggio"]
REJECTED_TYPES = ["parking", "parking_lot", "parking_garage", "bus_station", "bus_stop", "transit_station", "transit_stop"]
CATEGORY_WORDS = HUT_WORDS + BIVOUAC_WORDS + OTHER_LODGING_WORDS
CONTRADICTING = {"hut": BIVOUAC_WORDS + OTHER_LODGING_WORDS, "bivouac": HUT_WORDS + OTHER_LODGING_WORDS}
# What a name of each type begins with, words that name nothing, words that hint at a type.
TYPE_PREFIXES = {"hut": ["rifugio", "rif"], "bivouac": ["bivacco", "biv"], "peak": ["monte", "m"], "ferrata": ["via", "ferrata"]}
STOP_WORDS = [
    "del", "della", "dei", "degli", "di", "d", "il", "lo", "la", "i", "gli", "le", "al", "allo", "alla", "agli", "alle", "all",
    "sul", "sulla", "sui", "sugli", "sulle", "nel", "nella", "nei", "negli", "nelle", "nell", "un", "una", "dal", "dall", "da",
]
TYPE_SIGNALS = {
    "hut": ["rifugio", "rif.", "capanna", "baita"], "bivouac": ["bivacco", "biv."],
    "peak": ["monte", "pizzo", "cima", "punta", "vetta", "corno"], "ferrata": ["ferrata", "scalata", "arrampicata"],
}
# Words of many mountain names.
GENERIC_WORDS = [
    "rifugio", "bivacco", "bivouac", "monte", "colle", "passo", "pizzo", "cima", "bocchetta", "forcella", "sentiero", "alpe", "valle",
    "hut", "lake", "pass", "trail", "mountain", "peak", "summit", "valley", "reservoir", "viewpoint", "waterfall", "junction",
]
# Keys of tags worth telling.
USEFUL_TAGS = [
    "name", "name:it", "alt_name", "official_name", "description", "description:it", "note", "note:it", "ele", "website", "contact:website", "url",
    "phone", "contact:phone", "email", "contact:email", "opening_hours", "seasonal", "capacity", "operator", "operator:it", "owner",
    "access", "access:description", "tourism", "mountain_pass", "natural", "ascent", "descent", "distance",
    "via_ferrata_scale", "sac_scale", "trail_visibility", "osmc:symbol", "network", "route",
    "addr:street", "addr:city", "addr:province", "wikipedia", "wikidata",
]


def fold(text) -> Column:
    """SCL-10: lower case without accents."""
    return F.translate(F.lower(col(text)), ACCENTED, PLAIN)


def fold_name(text) -> Column:
    """SCL-11: folded, without apostrophes, stops and backticks, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), "['’.`]", ""), r"\s+", " "))


def tokens(text) -> Column:
    """SCL-12: folded words of letters and digits."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: t != "")


def distinctive(text) -> Column:
    """SCL-13: tokens without those that name a kind of place."""
    return F.filter(tokens(text), lambda t: ~t.isin(CATEGORY_WORDS))


def by_type(kind, lists: dict[str, list[str]]) -> Column:
    """The list for a row's type; empty for another type."""
    out = F.array().cast("array<string>")
    for name, words in lists.items():
        out = F.when(col(kind) == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def core_tokens(text, kind) -> Column:
    """SCL-14: words without the leading ones that name the type, stop words and single letters."""
    t = F.filter(F.split(fold(text), r"[\s,.'\u2018\u2019\-\u2013\u2014]+"), lambda w: w != "")
    prefixes = by_type(kind, TYPE_PREFIXES)
    first = F.aggregate(t, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, w: F.struct((s["n"] + F.when(s["on"] & F.array_contains(prefixes, w), 1).otherwise(0)).alias("n"), (s["on"] & F.array_contains(prefixes, w)).alias("on")))["n"]
    rest = F.slice(t, first + 1, F.greatest(F.size(t), F.lit(1)))
    return F.filter(rest, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) >= 2))


def name_tier(own, other) -> Column:
    """SCL-15: 1 for the same tokens, 2 if one set holds the other, 3 if all own distinctive tokens are in the other, else null."""
    x, y, d = F.array_distinct(tokens(own)), F.array_distinct(tokens(other)), distinctive(own)
    within = lambda p, q: F.size(F.array_except(p, q)) == 0
    return F.when(within(x, y) & within(y, x), 1).when(within(x, y) | within(y, x), 2).when((F.size(d) > 0) & within(d, y), 3)


def strip_kind(text) -> Column:
    """SCL-16: the folded name without a leading kind of hut."""
    return F.trim(F.regexp_replace(fold_name(text), r"^(rifugio|bivacco|bivouac)\s+", ""))


def has_word(text, word) -> Column:
    """SCL-17: whether a word stands in the text by itself."""
    return F.array_contains(tokens(text), col(word))


def truncate_words(text, n: int) -> Column:
    """SCL-18: cut at the last word border within n characters."""
    t = col(text)
    head = F.substring(t, 1, n)
    whole = (F.length(t) <= n) | (F.substring(t, n + 1, 1) == " ")
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.rtrim(F.when(whole, head).when(cut != "", cut).otherwise(head))


def strip_html(text) -> Column:
    """SCL-19: without tags, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(text), r"<[^>]*>", " "), r"\s+", " "))


def cache_key(osm_id, name, kind) -> Column:
    """SCL-20: digest of the id, or else of name and kind."""
    other = F.concat(F.lower(F.trim(col(name))), F.lit("::"), F.lower(F.trim(col(kind))))
    return F.sha2(F.coalesce(col(osm_id).cast("string"), other), 256)


def percent(text) -> Column:
    """SCL-21: percent encoding as in a URI component."""
    out = F.replace(F.url_encode(col(text)), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def escape(text, quotes: bool = True) -> Column:
    """SCL-22: signs of markup as entities."""
    out = col(text)
    for sign, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&apos;")] if quotes else []):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def safe_url(url) -> Column:
    """SCL-23: the address if it is http or https, else null."""
    return F.when(F.try_parse_url(col(url), F.lit("PROTOCOL")).isin("http", "https"), col(url))


def month_label(ts) -> Column:
    """SCL-24."""
    return F.date_format(col(ts), "yyyy-MM")


def leading_int(text) -> Column:
    """The whole number a text begins with; null if there is none or it is 0."""
    n = F.regexp_extract(col(text).cast("string"), r"^\s*([+-]?\d{1,9})", 1).try_cast("int")
    return F.when(n != 0, n)


# Grades as letters and digits, in order.
LETTERS = ["A", "B", "C", "D", "E", "F"]
DIGITS = ["1", "2", "3", "4", "5", "6"]


def grade(text) -> Column:
    """SCL-27: 1 to 6 as A to F, letters A to F in upper case, else null."""
    t = F.upper(F.trim(col(text)))
    from_digit = F.element_at(F.create_map(*[F.lit(x) for pair in zip(DIGITS, LETTERS, strict=True) for x in pair]), t)
    return F.coalesce(from_digit, F.when(t.rlike("^[A-F]$"), t))


def grade_tokens(low, high) -> Column:
    """FLT-12: the letters and digits of a range; a bound that is no grade is open, an empty range is null."""
    a = F.coalesce(F.array_position(F.array(*map(F.lit, LETTERS)), grade(low)), F.lit(1))
    z = F.coalesce(F.array_position(F.array(*map(F.lit, LETTERS)), grade(high)), F.lit(6))
    cut = lambda xs: F.slice(F.array(*map(F.lit, xs)), a.cast("int"), F.greatest(z - a + 1, F.lit(0)).cast("int"))
    return F.when(a <= z, F.concat(cut(LETTERS), cut(DIGITS)))


def slug(url) -> Column:
    """SCL-35: last part of the path without .html."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(F.try_parse_url(col(url), F.lit("PATH")), "/+$", ""), "/", -1), r"\.html?$", "")


def capitalised(text) -> Column:
    """SCL-33: first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(col(text), 1, 1)), F.substring(col(text), 2, 1 << 30))
