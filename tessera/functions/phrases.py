"""Texts made from columns: descriptions, facts, templates, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import squeezed, trimmed

#: Attribute columns of a product and where they are renamed.
PRODUCT_ATTRIBUTES = ("gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage")

#: Question and answer templates of relations; {s} subject, {o} objects.
QUESTIONS = {
    "creative_director": ("Who is the creative director of {s}?", "The creative director of {s} is {o}."),
    "founded_by": ("Who founded {s}?", "{s} was founded by {o}."),
    "based_in": ("Where is {s} based?", "{s} is based in {o}."),
    "known_for": ("What is {s} known for?", "{s} is known for {o}."),
    "uses_material": ("What materials is {s} known for using?", "{s} frequently works with {o}."),
    "has_silhouette": ("What silhouettes are characteristic of {s}?", "{s} is characterised by {o} silhouettes."),
    "influenced_by": ("What has influenced {s}?", "{s} has been influenced by {o}."),
    "collaborated_with": ("Who has {s} collaborated with?", "{s} has collaborated with {o}."),
}
SINGLE_VALUED = ("creative_director", "founded_by", "based_in")
CAPTION_TEMPLATES = (
    "Describe a runway look from {d}'s {s} collection.",
    "What might a {d} look from {s} feature?",
    "Give a short styling description of a {d} {s} runway look.",
)
HEDGES = ("not specified", "not specified in text", "likely", "n/a", "unknown", "high fashion brand")
CONCEPT_HEDGES = ("not specified", "not specified in text", "likely", "high fashion brand")

#: What a reply's depth and format ask for.
DEPTHS = {
    "surface": "Be concise and conversational — a few sentences, no headers.",
    "detailed": "Be thorough and well-structured. Use clear sections and concrete, specific recommendations.",
    "expert": "Give an expert, in-depth treatment: precise fashion terminology, rationale behind each choice, and trade-offs a creative director would weigh.",
}
FORMATS = {
    "chat": "Respond in natural prose.",
    "report": "Respond as a markdown report with '##' section headers and tight prose under each.",
    "visual": "Respond as compact, labelled blocks suitable for cards on a canvas; keep each block self-contained.",
}


def filled(template: str, **parts: Column) -> Column:
    """A template with {name} places as a concat."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest))


def describe_product(name: Column, attributes: dict[str, Column]) -> Column:
    """``{name}. a: x; b: y`` of the attributes that hold something; empty if nothing is known."""
    known = [F.when(~F.lower(trimmed(v.cast("string"))).isin("nan", "none", ""), F.concat(F.lit(f"{k}: "), trimmed(v.cast("string")))) for k, v in attributes.items()]
    parts = F.concat_ws("; ", *known)
    bare = F.coalesce(trimmed(name.cast("string")), F.lit(""))
    head = F.when(bare == "", F.lit("Fashion product")).otherwise(bare)
    return F.when(parts != "", F.concat(head, F.lit(". "), parts)).otherwise(bare)


def instruction(profile: Column, context: Column, advice: Column) -> Column:
    """A styling record as one passage; null if there is no advice."""
    given = {"i": F.coalesce(trimmed(profile), F.lit("")), "c": F.coalesce(trimmed(context), F.lit("")), "a": trimmed(advice)}
    text = filled("Styling example. Profile: {i}. Occasion: {c}. Advice: {a}", **given)
    return F.when(F.coalesce(trimmed(advice), F.lit("")) != "", text)


def fact_text(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat_ws(" ", subject, F.translate(relation, "_", " "), obj)


def path_text(start: Column, steps: Column) -> Column:
    """``A —rel→ B —rel→ C`` of array<struct<relation, to>>."""
    return F.concat(start, F.array_join(F.transform(steps, lambda s: F.concat(F.lit(" —"), s["relation"], F.lit("→ "), s["to"])), ""))


def joined(items: Column, most: int = 5) -> Column:
    """``a``, ``a and b``, ``a, b, and c`` of the first five."""
    items = F.slice(items, 1, most)
    n = F.size(items)
    last = F.element_at(items, -1)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, last)
        .when(n == 2, F.concat(F.element_at(items, 1), F.lit(" and "), last))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), last))
    )


def clean_object(c: Column, drop_temporal: bool = False) -> Column:
    """Readable object phrases; null for hedges, overlong ones and, if asked, dates and seasons."""
    t = F.regexp_replace(squeezed(F.translate(c, "_", " ")), r"^[ .,]+|[ .,]+$", "")
    bad = (t == "") | (F.length(t) > 60) | F.lower(t).isin(*HEDGES)
    if drop_temporal:
        bad = bad | t.rlike(r"(19|20)\d{2}") | t.rlike(r"(?i)\b(spring|fall|autumn|winter|resort|pre-fall|couture)\b")
    return F.when(~bad, t)


def clean_concept(c: Column, max_words: int = 3) -> Column:
    """Short lower-case descriptors; null for years, hedges and long phrases."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(trimmed(c)), "_", " "), "[^a-z0-9 ]+", " "), r"\s+", " "))
    bad = (t == "") | t.rlike(r"^(19|20)\d{2}s?$") | (F.size(F.split(t, " ")) > max_words) | t.isin(*CONCEPT_HEDGES)
    return F.when(~bad, t)


def question(relation: Column, subject: Column) -> Column:
    out = F.lit(None).cast("string")
    for r, (q, _) in QUESTIONS.items():
        out = F.when(relation == r, filled(q, s=subject)).otherwise(out)
    return out


def answer(relation: Column, subject: Column, objects: Column) -> Column:
    out = F.lit(None).cast("string")
    for r, (_, a) in QUESTIONS.items():
        phrase = joined(F.slice(objects, 1, 2) if r in SINGLE_VALUED else objects)
        out = F.when(relation == r, filled(a, s=subject, o=phrase)).otherwise(out)
    return out


def caption_prompt(row: Column, designer: Column, show: Column) -> Column:
    """The template that a line's number (blank lines count) picks."""
    season = F.when(F.coalesce(show, F.lit("")) == "", F.lit("recent")).otherwise(show)
    return F.element_at(F.array(*(filled(t, d=designer, s=season) for t in CAPTION_TEMPLATES)), (F.pmod(row, F.lit(len(CAPTION_TEMPLATES))) + 1).cast("int"))


def directive(depth: str = "detailed", form: str = "report") -> str:
    """What to append to a system prompt; ValueError for unknown words."""
    if depth not in DEPTHS or form not in FORMATS:
        raise ValueError(f"unknown depth or format: {depth!r}, {form!r}")
    return f"{DEPTHS[depth]} {FORMATS[form]}"


def passage_line(title: Column, source: Column, document: Column) -> Column:
    """``- [title or source] snippet`` on one line."""
    tag = F.coalesce(F.when(title != "", title), source, F.lit("source"))
    return F.concat(F.lit("- ["), tag, F.lit("] "), F.replace(trimmed(document), F.lit("\n"), F.lit(" ")))


def knowledge_block(facts: Column, passages: Column) -> Column:
    """Facts first, then passages; empty parts are left out. ``facts`` array<string>, ``passages`` string."""
    told = F.when(F.size(facts) > 0, F.concat(F.lit("Knowledge-graph facts:\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")))
    read = F.when(F.coalesce(passages, F.lit("")) != "", F.concat(F.lit("Retrieved passages:\n"), passages))
    return F.concat_ws("\n\n", told, read)


def verdict(raw: Column) -> Column:
    """A, B or tie from a judge's reply."""
    up = F.upper(trimmed(F.coalesce(raw, F.lit(""))))
    tail = F.when(F.instr(up, "VERDICT") > 0, F.substring(up, F.instr(up, "VERDICT") + 7, F.length(up)))
    named = F.regexp_extract(tail, "[AB]", 0)
    plain = F.when(up.startswith("TIE") | (up == "EQUAL"), "tie").when(up.startswith("A"), "A").when(up.startswith("B"), "B").otherwise("tie")
    return F.when(tail.isNotNull(), F.when(tail.contains("TIE") | tail.contains("EQUAL"), "tie").when(named != "", named).otherwise(plain)).otherwise(plain)


def unblinded(v: Column, kg_is_a: Column) -> Column:
    """The arm that a blind verdict chose."""
    return F.when(v == "tie", "tie").when((v == "A") == kg_is_a, "kg").otherwise("rag")


def coverage(answer_text: Column, gold: Column) -> Column:
    """Share of gold terms that the answer holds, whatever their case; empty terms count as missed."""
    low = F.lower(F.coalesce(answer_text, F.lit("")))
    hits = F.size(F.filter(gold, lambda t: (t != "") & low.contains(F.lower(t))))
    return F.when(F.size(gold) > 0, hits / F.size(gold)).otherwise(0.0)
