"""Prompts, conversations and training targets as column expressions. The wording of templates is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import OMITTED, contains_any, strip
from ..functions.vectors import let

CAPTION_TEMPLATE = [
    ("Audio caption", "audio_caption"), ("Audio tags", "audio_tags"), ("Sound class", "ast_classification"), ("Caption candidates", "conette_candidates"),
    ("Music caption", "music_caption"), ("Tags per second", "sat_predictions"), ("Frame descriptions", "descriptions"), ("Objects", "objects"),
    ("Places", "places"), ("Video caption", "caption"), ("Subtitle", "text"), ("Duration", "duration"),
]


def field(label: str, value: Column) -> Column:
    """'label: value', null where the value is null or blank."""
    return F.when(strip(value) != "", F.concat(F.lit(f"{label}: "), value))


def fields(pairs: list[tuple[str, Column]], head: str = "", tail: str = "") -> Column:
    """Non-empty fields on lines of their own between a head and a tail."""
    return F.concat_ws("\n", *([F.lit(head)] if head else []), *[field(n, v) for n, v in pairs], *([F.lit(tail)] if tail else []))


def caption_fields(row: dict[str, Column]) -> list[tuple[str, Column]]:
    """The fields of the full caption prompt in order, of the columns given: tags and labels as score-filtered JSON, the
    music caption only where the subtitle speaks of music."""
    out = []
    for label, name in CAPTION_TEMPLATE:
        if name in row:
            x = row[name]
            if name == "audio_tags":
                x = map_json(x)
            elif name in ("objects", "places"):
                x = F.when(F.exists(x, lambda s: s.score > 0.5), scored_json(x))
            elif name == "descriptions":
                x = F.array_join(x, " ")
            elif name == "sat_predictions":
                x = F.when(F.size(x) > 0, F.to_json(x))
            elif name == "music_caption" and "text" in row:
                x = music_line(row["text"], x)
            out.append((label, x.cast("string")))
    return out


def music_line(text: Column, music: Column) -> Column:
    """The music caption only where the subtitle speaks of music."""
    return F.when(F.lower(text).contains("music"), music)


def scored_json(items: Column, least: float = 0.5) -> Column:
    """JSON of the structs whose score is above the bound."""
    return F.to_json(F.filter(items, lambda x: x.score > least))


def map_json(scores: Column, least: float = 0.5) -> Column:
    """JSON list of labels and scores above the bound, by label."""
    entries = F.array_sort(F.filter(F.map_entries(scores), lambda e: e.value > least))
    return F.to_json(F.transform(entries, lambda e: F.struct(e.key.alias("label"), e.value.alias("score"))))


def literal_map(text: Column) -> Column:
    """A map of label to score from text in literal form, without evaluating it. Labels stand in single quotes, or in double
    quotes where they hold an apostrophe; null for any other text."""
    return F.from_json(text, "map<string,double>", {"allowSingleQuotes": "true"})


def judge_prompt(generated: Column, rubric: str = "Reply with JSON holding the key valid.") -> Column:
    return F.concat(F.lit("Judge the text below. " + rubric + "\n\n"), generated)


def rubric_prompt(question: Column, reference: Column, prediction: Column, scale: str = "0 to 5") -> Column:
    return F.concat_ws("\n", F.concat(F.lit("[Question] "), question), F.concat(F.lit("[Reference answer] "), reference), F.concat(F.lit("[Model answer] "), prediction), F.lit(f"Rate the model answer from {scale}. End with 'Rating: ' and the number."))


def visual_prompt(objects: Column, places: Column, descriptions: Column) -> Column:
    """Optional sections, each left out where empty."""
    part = lambda n, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(n + ": "), c))
    return F.concat_ws("\n", F.lit("Describe the audio. What is seen may help:"), part("Objects", objects), part("Places", places), part("Frames", descriptions))


def lettered(choices: Column) -> Column:
    """'A. first\\nB. second' of an array."""
    return F.array_join(F.transform(choices, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), x)), "\n")


def lettered_map(choices: Column) -> Column:
    """The same of a map of letters, by letter."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(e.key, F.lit(". "), e.value)), "\n")


def question_with_choices(question: Column, choices: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\nChoices:\n"), F.array_join(choices, " "))


def multiple_choice_prompt(question: Column, choices: Column) -> Column:
    return F.concat(F.replace(question, F.lit("\n"), F.lit("")), F.lit(" Please choose the answer from the following options: "), lettered_map(choices), F.lit("."))


def with_suffix(prompt: Column, semantic: bool = False, long: bool = False, target: int | None = None) -> Column:
    """Instructions on the form of the reply, by mode."""
    parts = ["think", *(["semantic_elements"] if semantic else []), "answer"]
    text = " Reply in the tags " + ", ".join(f"<{p}>" for p in parts) + "."
    text += " Think at length." if long else ""
    text += f" Think in about {target} words." if target is not None else ""
    return F.concat(prompt, F.lit(text))


def target_text(thinking: Column, answer: Column, semantic: Column | None = None) -> Column:
    """'<think>..</think>\\n[<semantic_elements>..</semantic_elements>\\n]<answer>..</answer>' of stripped parts; null parts are empty."""
    wrap = lambda t, c: F.concat(F.lit(f"<{t}>"), strip(F.coalesce(c, F.lit(""))), F.lit(f"</{t}>"))
    return F.concat_ws("\n", wrap("think", thinking), *([wrap("semantic_elements", semantic)] if semantic is not None else []), wrap("answer", answer))


def conversation(user: Column, assistant: Column | None = None, system: Column | None = None) -> Column:
    """Array of struct(role, content); the assistant turn only in training."""
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(*([turn("system", system)] if system is not None else []), turn("user", user), *([turn("assistant", assistant)] if assistant is not None else []))


def valid_caption(answer: Column, thinking: Column, semantic: Column | None = None) -> Column:
    """At most 100 words, at least 10 characters in every part, none of the phrases that give the source away."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    ok = (F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != "")) <= 100) & (size(answer) >= 10) & (size(thinking) >= 10)
    ok = ok & ~contains_any(thinking, OMITTED) & ~contains_any(answer, OMITTED)
    if semantic is not None:
        ok = ok & (size(semantic) >= 10) & ~contains_any(semantic, OMITTED)
    return F.coalesce(ok, F.lit(False))


def valid_pair(p: Column, least_question: int = 10, least_thinking: int = 10, least_answer: int = 3, semantic: bool = False, choices: list[str] | None = None) -> Column:
    """A question-answer pair with all parts, long enough and without the phrases. semantic asks the same of its
    semantic elements; choices names the letters of which each must have a non-empty choice, and no other may."""
    ok = (F.length(p.question) >= least_question) & (F.length(p.thinking) >= least_thinking) & (F.length(p.answer) >= least_answer)
    ok = ok & ~contains_any(p.thinking, OMITTED) & ~contains_any(p.answer, OMITTED)
    if semantic:
        ok = ok & (F.length(p.semantic_elements) >= least_thinking) & ~contains_any(p.semantic_elements, OMITTED)
    if choices is not None:
        named = F.array_sort(F.map_keys(p.choices)) == F.array(*[F.lit(x) for x in sorted(choices)])
        ok = ok & named & F.forall(F.map_values(p.choices), lambda v: F.coalesce(strip(v) != "", F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def masked_labels(ids: Column, pattern: list[int], ignore: int = -100) -> Column:
    """Token ids with everything up to and including the first occurrence of the pattern ignored; all, if there is none."""
    n = len(pattern)
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids) - n + 1, F.lit(1))), lambda i: F.slice(ids, i, n) == F.array(*[F.lit(p) for p in pattern]))
    return let(F.array_position(starts, True), lambda at: F.transform(ids, lambda x, i: F.when((at > 0) & (i >= at - 1 + n), x).otherwise(ignore)))


def mask_after_end(ids: Column, end: int, drop_unfinished: bool = False) -> Column:
    """1 up to and including the first end token, else 0; a row without it is all 1, or all 0 if dropped."""
    return let(F.array_position(ids, end), lambda at: F.transform(ids, lambda x, i: F.when(at == 0, F.lit(0 if drop_unfinished else 1)).when(i < at, 1).otherwise(0)))
