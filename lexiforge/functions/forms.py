"""Forms of words by rules that are data: endings and prefixes applied to stems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Rule, ladder, rewritten


def paradigm(word: Column, rules: Mapping[str, tuple[str, str, str]]) -> Column:
    """Map from form to its name, by rules name -> (ending to cut, ending to add, prefix).

    The first name wins where forms coincide.
    """
    return F.map_from_entries(_first_names(_entries(word, rules)))


def closed_paradigm(word: Column, rules: Mapping[str, tuple[str, str, str]], swaps: Sequence[tuple[str, str]]) -> Column:
    """As paradigm(), with the spelling variants of every form under the form's name; true forms come first."""
    plain = _entries(word, rules)
    spelt = F.flatten(F.transform(plain, lambda e: F.transform(variants(e["form"], swaps), lambda v: F.struct(v.alias("form"), e["name"].alias("name")))))
    return F.map_from_entries(_first_names(F.concat(plain, spelt)))


def _first_names(found: Column) -> Column:
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["form"]), x["form"]) == i + 1)


def _entries(word: Column, rules: Mapping[str, tuple[str, str, str]]) -> Column:
    entries = []
    for name, (cut, add, prefix) in rules.items():
        stem = F.when(F.lit(cut == ""), word).when(F.endswith(word, F.lit(cut)), F.expr(f"left({_name(word)}, length({_name(word)}) - {len(cut)})"))
        entries.append(F.when(stem.isNotNull(), F.struct(F.concat(F.lit(prefix), stem, F.lit(add)).alias("form"), F.lit(name).alias("name"))))
    return F.array_compact(F.array(*entries))


def _name(word: Column) -> str:
    return word._jc.toString()


def variants(word: Column, swaps: Sequence[tuple[str, str]]) -> Column:
    """The word and what each spelling swap makes of it, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.array(word, *(F.replace(word, F.lit(a), F.lit(b)) for a, b in swaps))))


@dataclass(frozen=True)
class FormRules:
    """How the forms of a word are made.

    The stem is the word without `ending`, changed by the first of `stems` that
    matches it and then by all of `finals` in order. Each of `kinds` puts a
    prefix and an ending to the stem. `spellings` are carried out on the word and
    on every form, and on what comes of that, until nothing new comes. Words in
    `exceptions` have the forms listed there in place of those of `kinds`.
    """

    ending: str
    stems: Sequence[Rule]
    finals: Sequence[Rule]
    kinds: Mapping[str, tuple[str, str]]
    spellings: Sequence[Rule]
    exceptions: Mapping[str, Sequence[str]] = field(default_factory=dict)


def stem(word: Column, rules: FormRules) -> Column:
    bare = F.when(F.endswith(word, F.lit(rules.ending)), F.substring(word, F.lit(1), F.char_length(word) - len(rules.ending))).otherwise(word)
    changed = F.transform(F.array(bare), lambda s: ladder([(s.rlike(r.pattern), F.regexp_replace(s, r.pattern, r.replacement)) for r in rules.stems], s) if rules.stems else s)[0]
    return rewritten(changed, [(r.pattern, r.replacement) for r in rules.finals])


def closure(forms: Column, rules: Sequence[Rule], rounds: int = 8) -> Column:
    """The forms (an array) and all that the rules make of them, of those, and so on, in the order in which they come.

    Raises where so many rounds don't reach an end.
    """
    step = lambda known: F.array_distinct(F.concat(known, F.flatten(F.transform(known, lambda f: F.array(*(F.regexp_replace(f, r.pattern, r.replacement) for r in rules))))))
    if not rules:
        return F.array_distinct(forms)
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array_distinct(forms), lambda known, _: step(known))
    settled = lambda known: F.when(F.size(step(known)) == F.size(known), known).otherwise(F.raise_error(F.lit("the spelling rules reach no end")).cast("array<string>"))
    return F.transform(F.array(grown), settled)[0]


def all_forms(word: Column, rules: FormRules, rounds: int = 8) -> Column:
    """Array of (form, kind): the word's own spellings as lemma, then those of its irregular or regular forms; the first kind of a form counts."""
    named = lambda kind, forms: F.transform(closure(forms, rules.spellings, rounds), lambda f: F.struct(f.alias("form"), F.lit(kind).alias("kind")))
    regular = F.concat(*(named(kind, F.array(F.concat(F.lit(prefix), stem(word, rules), F.lit(ending)))) for kind, (prefix, ending) in rules.kinds.items()))
    if rules.exceptions:
        table = F.create_map(*(x for w, forms in rules.exceptions.items() for x in (F.lit(w), F.array(*map(F.lit, forms)))))
        listed = F.try_element_at(table, word)
        regular = F.when(listed.isNotNull(), named("irregular", listed)).otherwise(regular)
    return F.transform(F.array(F.concat(named("lemma", F.array(word)), regular)), _first_kinds)[0]


def _first_kinds(found: Column) -> Column:
    """The first entry of each form; one pass keeps the forms seen so far."""
    none = F.struct(F.array().cast("array<string>").alias("seen"), F.slice(found, 1, 0).alias("kept"))
    add = lambda a, x: F.when(F.array_contains(a["seen"], x["form"]), a).otherwise(F.struct(F.array_append(a["seen"], x["form"]).alias("seen"), F.array_append(a["kept"], x).alias("kept")))
    return F.aggregate(found, none, add, lambda a: a["kept"])
