"""What models are asked: chat messages and retrieval queries as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.naming import ENTITY_TYPES, RELATIONS
from tessera.functions.phrases import filled

#: Characters of a passage that a model reads at once, the retrieval query's tail and fallback, and the fields it is made of.
PASSAGE_CHARS = 3500
LOOK_QUERY, BRAND_FALLBACK = "styling advice outfit", "fashion brand identity"
BRAND_QUERY = ("aesthetic", "inspirations", "category", "values")

JSON_TRIPLES = "Answer with a JSON array alone. Every element has the keys subject, subject_type, relation, object and object_type; an empty array if there is nothing to say."


def messages(system: Column | str, user: Column) -> Column:
    """array<struct<role, content>> of a system and a user message."""
    system = F.lit(system) if isinstance(system, str) else system
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def _listed(items: Column, empty: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(empty))


def extraction(text: Column, source: Column) -> Column:
    """Asks for the triples that a passage states."""
    system = f"Read the passage and write down the fashion facts that it states, none that it does not. {JSON_TRIPLES} Relations: {', '.join(sorted(RELATIONS))}. Types: {', '.join(sorted(ENTITY_TYPES))}. Prefer a precise relation to known_for."
    return messages(system, filled("Source: {s}\n\nPassage:\n{t}\n\nTriples:", s=F.coalesce(source, F.lit("")), t=F.substring(F.coalesce(text, F.lit("")), 1, PASSAGE_CHARS)))


def prediction(entity: Column, facts: Column, k: int = 5) -> Column:
    """Asks for up to ``k`` likely facts about an entity that are not among ``facts`` (array<string>)."""
    system = f"Name likely facts that a fashion knowledge graph lacks. The entity is every fact's subject; repeat none that is known. {JSON_TRIPLES} Relations: {', '.join(sorted(RELATIONS))}."
    return messages(system, filled("Entity: {e}\nKnown:\n{f}\n\n{k} missing facts at most:", e=entity, f=_listed(facts, "- (none)"), k=F.lit(str(k))))


def look(designer: Column, show: Column) -> Column:
    """Asks what a picture shows; the picture goes beside the message (see ``encoded_image``)."""
    system = "Tell what the runway picture shows, as one JSON object with the keys caption (a sentence) and silhouettes, materials, aesthetics, garments and palette (lists). Say what can be seen and nothing else."
    return messages(system, filled("Designer: {d}. Collection: {s}. The look as JSON:", d=F.coalesce(designer, F.lit("")), s=F.coalesce(show, F.lit(""))))


def grounded_answer(question: Column, knowledge: Column) -> Column:
    known = F.when(F.coalesce(knowledge, F.lit("")) != "", knowledge).otherwise(F.lit("(none)"))
    return messages("Answer from the knowledge given and from nothing else. Leave out what it does not hold.", filled("Knowledge:\n{k}\n\nQuestion: {q}", k=known, q=question))


def judgement(question: Column, a: Column, b: Column) -> Column:
    """Asks which of two answers states more; the reply ends in a VERDICT line."""
    system = "Judge two answers by the number of specific, correct facts they state. Give a sentence of reason, then one line: VERDICT: A, VERDICT: B, or VERDICT: TIE if neither states more."
    return messages(system, filled("Question: {q}\n\nAnswer A:\n{a}\n\nAnswer B:\n{b}", q=question, a=a, b=b))


def key_facts_question(name: Column) -> Column:
    return filled("What are the key facts about {n}: founder, seat, creative director, materials and silhouettes, influences, and what it is known for?", n=name)


def topic_analysis(topic: Column, knowledge: Column, style: str = "") -> Column:
    return messages(f"Analyse trends as an editor and a strategist would. {style}".strip(), filled("Topic: {t}\n\nKnowledge:\n{k}\n\nSections: definition, origins, trajectory, drivers, players, implications, neighbours and counter-trends.", t=topic, k=F.coalesce(knowledge, F.lit(""))))


def brand_foundation(answers: Column, knowledge: Column, style: str = "") -> Column:
    """``answers`` is a map of onboarding answers."""
    told = F.array_join(F.transform(F.array_sort(F.map_keys(answers)), lambda k: F.concat(F.lit("- "), k, F.lit(": "), answers[k])), "\n")
    return messages(f"Turn a founder's answers into a coherent brand. {style}".strip(), filled("Answers:\n{a}\n\nKnowledge:\n{k}\n\nSections: brand DNA, positioning, signature, starter collection, next steps.", a=told, k=F.coalesce(knowledge, F.lit(""))))


def look_review(garments: Column, occasion: Column, lineage: Column, knowledge: Column, style: str = "") -> Column:
    """``garments`` and ``lineage`` are array<string>; empty parts are left out."""
    blank = F.lit("")
    parts = F.concat_ws(
        "\n\n",
        filled("Garments: {g}", g=F.when(F.size(garments) > 0, F.array_join(garments, ", ")).otherwise(F.lit("not detected"))),
        F.when(F.coalesce(occasion, blank) != "", filled("Occasion: {o}", o=occasion)),
        F.when(F.size(lineage) > 0, filled("Nearest looks:\n{l}", l=_listed(lineage, ""))),
        F.when(F.coalesce(knowledge, blank) != "", filled("Knowledge:\n{k}", k=knowledge)),
        F.lit("Sections: silhouette, colour, occasion, lineage, what works, three changes."),
    )
    return messages(f"Review an outfit as an honest and kind stylist. Speak of resemblance, never of attribution. {style}".strip(), parts)


def brand_query(answers: Column) -> Column:
    """The retrieval query of onboarding answers (a map); a general one if none of its fields is told."""
    said = F.array_compact(F.array(*(F.when(F.coalesce(F.try_element_at(answers, F.lit(k)), F.lit("")) != "", F.try_element_at(answers, F.lit(k))) for k in BRAND_QUERY)))
    text = F.trim(F.array_join(said, " "))
    return F.when(text != "", text).otherwise(F.lit(BRAND_FALLBACK))


def look_query(garments: Column, occasion: Column) -> Column:
    """The retrieval query of a look: garments, occasion if there is one, and what is sought."""
    return F.concat_ws(" ", garments, F.when(F.coalesce(occasion, F.lit("")) != "", occasion), F.lit(LOOK_QUERY))


def encoded_image(content: Column) -> Column:
    """An image's bytes as base64 in one line, as multimodal messages carry them."""
    return F.translate(F.base64(content), "\r\n", "")


def look_descriptor(designer: Column, show: Column, label: Column) -> Column:
    """What a look's metadata say, for ranking by text; empty if they say nothing."""
    return F.concat_ws(" ", *(F.when(c != "", c) for c in (designer, show, label)))


def told_hit(designer: Column, show: Column, look_index: Column, label: Column, source: Column) -> Column:
    """One line on a hit: house and show if either is known, else its label, else that it has none."""
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    house = F.concat(F.coalesce(designer, F.lit("Unknown")), F.lit(" — "), F.coalesce(show, F.lit("Unknown show")), F.when(look_index.isNotNull(), F.concat(F.lit(", look "), look_index.cast("string"))).otherwise(F.lit("")))
    labelled = F.concat(label, F.lit(" (source: "), F.coalesce(source, F.lit("fashionpedia")), F.lit(")"))
    return F.when(known(designer) | known(show), house).when(known(label), labelled).otherwise(F.concat(F.lit("unlabeled look (source: "), F.coalesce(source, F.lit("unknown")), F.lit(")")))
