"""Column builders for text: normal forms, tokens, keys, windows and tolerant parsers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = r"\p{L}+"


def normal(text: Column) -> Column:
    """Lower case, long s and ligatures resolved, letters only, single blanks."""
    out = F.replace(F.replace(F.replace(F.lower(text), F.lit("ſ"), F.lit("s")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.trim(F.regexp_replace(out, r"[^\p{L}]+", " "))


def tokens(text: Column) -> Column:
    """Array of lower-cased letter runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def slug(text: Column) -> Column:
    """ASCII letters and digits, everything else squeezed to one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tolerant_bool(text: Column) -> Column:
    """true, 1, yes, y, ja, x; false, 0, no, n, nee; null for anything else."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes", "y", "ja", "x"), True).when(low.isin("false", "0", "no", "n", "nee"), False)


def strict_bool(text: Column) -> Column:
    """As tolerant_bool, but anything other than a blank that it does not know raises."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.coalesce(tolerant_bool(text), F.when(~blank, F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")))


def blank_to_null(text: Column) -> Column:
    """Null for blank text and for the spellings nan and none."""
    low = F.lower(F.trim(text))
    return F.when(~low.isin("", "nan", "none"), F.trim(text))


def tag_set(text: Column, separator: str = "|") -> Column:
    """Sorted distinct lower-cased members of a delimited list; empty for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "\\" + separator)
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")))


#: Members of a list literal: quoted by either mark (the other may stand inside, a backslash hides the same), or bare.
_QUOTED = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
_MEMBER = rf"""(?:{_QUOTED}|[^\s,'"\[\]]++)"""
_LITERAL = rf"(?s)\s*\[\s*(?:{_MEMBER}\s*+(?:,\s*{_MEMBER}\s*+)*+,?+)?+\s*\]\s*"


def parse_list(text: Column) -> Column:
    """Members of a list literal with single or double quotes; empty where it can't be read."""
    members = F.regexp_extract_all(text, F.lit(f"(?s){_MEMBER}"), F.lit(0))
    bare = lambda m: F.when(m.rlike("""(?s)^['"]"""), F.regexp_replace(F.substring(m, F.lit(2), F.char_length(m) - 2), r"""\\(['"\\])""", "$1")).otherwise(m)
    return F.when(text.rlike(f"^{_LITERAL}$"), F.transform(members, bare)).otherwise(F.array().cast("array<string>"))


def year_of(text: Column) -> Column:
    """First year from 1200 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text, "(1[2-9][0-9][0-9]|20[0-9][0-9])", 1), F.lit("")).cast("int")


def floor_to(year: Column, span: int) -> Column:
    """The first year of a span of years."""
    return (F.floor(year / span) * span).cast("int")


def whole_seconds(at: Column) -> Column:
    """Seconds since 1970 of a time, to the nearest (of two as near the even one), as SQL casts a fraction to a whole number."""
    return F.rint(F.unix_micros(at.cast("timestamp")) / 1e6).cast("long")


def window_around(text: Column, at: Column, radius: int) -> Column:
    """Characters within radius of a 1-based place; the head of the text where the place is 0."""
    start = F.greatest(F.lit(1), at - radius)
    return F.when(at > 0, F.substring(text, start, at + radius - start)).otherwise(F.substring(text, F.lit(1), F.lit(2 * radius)))


def keyword_windows(df: DataFrame, words: str, terms: Sequence[str], radius: int) -> DataFrame:
    """df without its words, and pos, term, before, after for every word that is a term; no row carries the whole array."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("term"))), lambda h: h["term"].isin(*terms))
    left = lambda p: F.slice(words, F.greatest(F.lit(1), p - radius + 1), F.least(p, F.lit(radius)))
    cut = lambda h: F.struct(h["pos"].alias("pos"), h["term"].alias("term"), F.array_join(left(h["pos"]), " ").alias("before"), F.array_join(F.slice(words, h["pos"] + 2, F.lit(radius)), " ").alias("after"))
    rest = [c for c in df.columns if c != words]
    return df.select(*rest, F.explode(F.transform(hits, cut)).alias("_k")).select(*rest, "_k.*")


def split_at_middle(df: DataFrame, text: str, term: str) -> DataFrame:
    """Rows that hold a term (lower case), with before, keyword and after: split at the term's
    occurrence nearest the middle (the left one of two), widened to the whole run of letters."""
    low, n = F.lower(text), len(term)
    rows = df.where(low.contains(term)).withColumn("_mid", F.floor(F.char_length(text) / 2).cast("int") + 1)
    right = F.expr(f"locate('{term}', lower(`{text}`), _mid)")
    back = F.instr(F.reverse(F.substring(low, F.lit(1), F.col("_mid") + n - 2)), term[::-1])
    left = F.when(back > 0, F.col("_mid") - back)
    nearest = F.when((right == 0) | (F.col("_mid") - left <= right - F.col("_mid")), left).otherwise(right)
    cut = rows.withColumn("_at", F.coalesce(nearest, right))
    cut = cut.withColumn("_b", F.substring(text, F.lit(1), F.col("_at") - 1)).withColumn("_a", F.substring(text, F.col("_at") + n, F.char_length(text)))
    x, y = F.regexp_extract("_b", r"\p{L}+\z", 0), F.regexp_extract("_a", r"^\p{L}+", 0)
    out = cut.withColumn("before", F.substring("_b", F.lit(1), F.char_length("_b") - F.char_length(x))).withColumn("keyword", F.concat(x, F.substring(text, F.col("_at"), F.lit(n)), y)).withColumn("after", F.substring("_a", F.char_length(y) + 1, F.char_length("_a")))
    return out.drop("_mid", "_at", "_a", "_b")


def ladder(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def mapped(value: Column, names: Mapping[str, str]) -> Column:
    """Values replaced by a small fixed mapping; null where unknown."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)


def rewritten(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered pattern and replacement rules, each applied to the last one's result."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


@dataclass(frozen=True)
class Rule:
    """A named rewriting of spellings; patterns may look around and refer back."""

    name: str
    pattern: str
    replacement: str


def spelling_key(text: Column, rules: Sequence[Rule], skip: Sequence[str] = ()) -> Column:
    """Normal form after the rules in order, without those named in skip."""
    return rewritten(normal(text), [(r.pattern, r.replacement) for r in rules if r.name not in skip])


def fired_rules(text: Column, rules: Sequence[Rule], skip: Sequence[str] = ()) -> Column:
    """Names of the rules that change the text, in order."""
    out, now = [], normal(text)
    for r in rules:
        if r.name not in skip:
            after = F.regexp_replace(now, r.pattern, r.replacement)
            out.append(F.when(after != now, F.lit(r.name)))
            now = after
    return F.array_compact(F.array(*out))


def eligible(text: Column, least: int = 3) -> Column:
    """Whether a spelling key stands for anything: one word of so many letters."""
    return normal(text).rlike(rf"^\p{{L}}{{{least},}}$")


def loose_key(text: Column, prefixes: Sequence[str] = ()) -> Column:
    """Doubled consonants squeezed, and a prefix written twice written once."""
    out = F.regexp_replace(normal(text), r"([b-df-hj-np-tv-z])\1+", "$1")
    return F.regexp_replace(out, rf"^({'|'.join(prefixes)})\1", "$1") if prefixes else out


def sound_key(text: Column, pairs: Sequence[tuple[str, str]], letters: tuple[str, str] = ("", "")) -> Column:
    """Letters that sound alike folded: groups by `pairs` in order, single ones by `letters`, repeats squeezed."""
    out = normal(text)
    for group, one in pairs:
        out = F.replace(out, F.lit(group), F.lit(one))
    return F.regexp_replace(F.translate(out, *letters), r"(.)\1+", "$1")


def swapped(word: Column, swaps: Sequence[tuple[str, str]]) -> Column:
    """Array of (other, swap): the word with one occurrence of one of the swaps carried out."""

    def one(a: str, b: str) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(word) - len(a) + 1))
        at = F.filter(places, lambda i: F.substring(word, i, F.lit(len(a))) == a)
        return F.transform(at, lambda i: F.struct(F.concat(F.substring(word, F.lit(1), i - 1), F.lit(b), F.substring(word, i + len(a), F.char_length(word))).alias("other"), F.lit(f"{a}>{b}").alias("swap")))

    return F.concat(*(one(a, b) for a, b in swaps))


def strip_tags(html: Column) -> Column:
    """Text of markup: scripts, comments and tags out, common entities resolved, blanks squeezed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def soft_match(a: Column, b: Column) -> Column:
    """Equal or one inside the other after normalising; two blanks match, one blank does not."""
    x, y = F.coalesce(normal(a), F.lit("")), F.coalesce(normal(b), F.lit(""))
    return F.when((x == "") & (y == ""), True).when((x == "") | (y == ""), False).otherwise(x.contains(y) | y.contains(x))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the multiset overlap of two token arrays; 1 for two empty ones. One fold over the sorted tokens of both."""
    side = lambda tokens, n: F.transform(tokens, lambda x: F.struct(x.alias("t"), F.lit(n).alias("s")))
    both = F.array_sort(F.concat(side(a, 0), side(b, 1)))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("n"))
    own = lambda e, n: (e["s"] == n).cast("int")
    more = lambda acc, e: F.struct(e["t"].alias("t"), (acc["x"] + own(e, 0)).alias("x"), (acc["y"] + own(e, 1)).alias("y"), acc["n"].alias("n"))
    fresh = lambda acc, e: F.struct(e["t"].alias("t"), own(e, 0).alias("x"), own(e, 1).alias("y"), (acc["n"] + F.least(acc["x"], acc["y"])).alias("n"))
    shared = F.aggregate(both, start, lambda acc, e: F.when(acc["t"].eqNullSafe(e["t"]), more(acc, e)).otherwise(fresh(acc, e)), lambda acc: acc["n"] + F.least(acc["x"], acc["y"]))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null without trials."""
    p = hits / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    whole = 1 + z * z / n
    low, high = (middle - half) / whole, (middle + half) / whole
    return F.when(n > 0, low), F.when(n > 0, high)


def hash_order(key: Column) -> Column:
    """A reproducible order that other engines can repeat: the first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def listed_forms(raw: Column, separators: str = ",;|") -> Column:
    """Distinct normal forms of a delimited list in its order, each followed by itself without blanks."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[" + "".join("\\" + c for c in separators) + "]"), normal)
    both = F.flatten(F.transform(parts, lambda p: F.array(p, F.replace(p, F.lit(" "), F.lit("")))))
    return F.array_distinct(F.filter(both, lambda p: p != ""))


def gloss_class(gloss: Column, heads: Mapping[str, str], rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The class of a gloss: by its first word, else by the first rule of which a keyword stands anywhere in it; null where none fits."""
    text = normal(gloss)
    found = ladder([(reduce(Column.__or__, (text.contains(k) for k in keywords)), F.lit(name)) for keywords, name in rules]) if rules else F.lit(None).cast("string")
    head = F.try_element_at(F.split(text, " "), F.lit(1))
    return F.when(text != "", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in heads.items() for x in pair)), head) if heads else F.lit(None), found))


def gloss_pairs(text: Column) -> Column:
    """Array of (form, gloss) for every word that is followed by a gloss in square brackets."""
    pattern = F.lit(r"([\p{L}'-]+)\s*\[([^\[\]]+)\]")
    groups = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("form"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("gloss"))
    return F.transform(groups, lambda g: F.struct(g["form"].alias("form"), F.trim(g["gloss"]).alias("gloss")))


@dataclass(frozen=True)
class GenreRules:
    """Rules of a catalogue's genre, in this order: schemes whose values name one; a scheme of codes, of which the first in
    `codes` counts; a scheme searched for patterns; the title."""

    schemes: Mapping[str, Mapping[str, str]]
    code_scheme: str
    codes: Sequence[tuple[str, str]]
    subject_scheme: str
    subjects: Sequence[tuple[str, str]]
    titles: Sequence[tuple[str, str]]


def genre(regime: Column, claims: Column, title: Column, rules: GenreRules, unknown: str = "UNKNOWN") -> Column:
    """(genre, source): the regime unless unknown, then what the rules find in the claims (array of scheme, value) and the title."""
    hit = lambda name, source: F.struct(name.alias("genre"), F.lit(source).alias("source"))
    found = lambda name, source: F.when(name.isNotNull(), hit(name, source))
    of = lambda scheme: F.transform(F.filter(claims, lambda c: c["scheme"] == scheme), lambda c: c["value"])
    steps = [F.when(F.coalesce(regime, F.lit(unknown)) != unknown, hit(regime, "regime"))]
    for scheme, names in rules.schemes.items():
        named = partial(F.try_element_at, F.create_map(*(F.lit(x) for pair in names.items() for x in pair)))
        steps.append(found(F.try_element_at(F.array_compact(F.transform(of(scheme), lambda v: named(v))), F.lit(1)), scheme))  # noqa: B023 - called at once
    codes = of(rules.code_scheme)
    steps.append(found(ladder([(F.array_contains(codes, code), F.lit(name)) for code, name in rules.codes]) if rules.codes else F.lit(None).cast("string"), rules.code_scheme))
    joined = F.array_join(of(rules.subject_scheme), " | ")
    steps.append(found(ladder([(joined.rlike(p), F.lit(name)) for name, p in rules.subjects]) if rules.subjects else F.lit(None).cast("string"), rules.subject_scheme))
    steps.append(found(ladder([(title.rlike(p), F.lit(name)) for name, p in rules.titles]) if rules.titles else F.lit(None).cast("string"), "title"))
    return F.coalesce(*steps, hit(F.lit(unknown), "none"))
