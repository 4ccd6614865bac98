"""Rewards of a completion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after_last, strip, tag, word_count, word_set
from .vectors import let

TAGS = ["think", "semantic_elements", "answer"]


def string_match(answer: Column, prediction: Column, choices: Column) -> Column:
    """All words of the answer are predicted and none that only wrong choices have; an empty prediction fails."""

    def compare(right: Column) -> Column:
        wrong = F.flatten(F.transform(choices, lambda c: F.array_except(word_set(c), right)))
        return let(word_set(prediction), lambda said: (F.size(said) > 0) & (F.size(F.array_except(right, said)) == 0) & ~F.arrays_overlap(said, wrong))

    return let(word_set(answer), compare)


def partial_accuracy(predicted: Column, answer: Column) -> Column:
    """0.5 if equal, 0.25 for equal first three characters, 0.25 for equal rests of two texts longer than three."""
    rest = lambda x: F.substring(x, 4, 1 << 30)
    head = lambda x: F.substring(x, 1, 3)
    long = (F.length(predicted) > 3) & (F.length(answer) > 3)
    score = F.when(predicted == answer, 0.5).otherwise(0.0) + F.when(head(predicted) == head(answer), 0.25).otherwise(0.0) + F.when(long & (rest(predicted) == rest(answer)), 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def number_value(x: Column) -> Column:
    """The value of a text that is one number, in any of the forms 1,000 -2.50 50% 3/4 $5; null for any other text."""
    t = F.regexp_replace(strip(x), r"[\s,$]", "")
    part = lambda i: F.regexp_extract(t, r"\A(-?\d*\.?\d+)/(-?\d*\.?\d+)\z", i).try_cast("double")
    share = F.regexp_extract(t, r"\A(-?\d*\.?\d+)%\z", 1).try_cast("double") / 100
    return F.coalesce(F.when(t.rlike(r"\A[-+]?\d*\.?\d+\z"), t.try_cast("double")), share, part(1) / F.nullif(part(2), F.lit(0.0)))


def symbolic_accuracy(completion: Column, answer: Column, tolerance: float = 1e-9) -> Column:
    """1 if the answers are the same number, however written, or else partial_accuracy of their texts."""
    said = tag(completion, "answer")
    a, b = number_value(said), number_value(answer)
    return F.when(F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(b), F.lit(1.0)), 1.0).otherwise(partial_accuracy(said, answer))


def exact_accuracy(completion: Column, answer: Column) -> Column:
    return F.when(tag(completion, "answer") == answer, 1.0).otherwise(0.0)


def length_reward(thinking: Column, target: int = 100, alpha: float = 0.1, delta: float = 0.5, encourage: bool = False) -> Column:
    n = word_count(thinking)
    value = F.lit(alpha) * (F.lit(target) - n) + delta
    if encourage:
        value = F.when(n <= target, 1.0 - F.lit(alpha) * (F.lit(target) - n) + delta).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def format_reward(x: Column, semantic: bool = False) -> Column:
    """0.5 for a completion that is nothing but its tags in order, white space between them."""
    parts = [t for t in TAGS if semantic or t != "semantic_elements"]
    return F.when(x.rlike(r"(?s)\A" + r"\s*".join(f"<{t}>.*?</{t}>" for t in parts) + r"\z"), 0.5).otherwise(0.0)


def tag_count_reward(x: Column, semantic: bool = False) -> Column:
    """0.125 for each pair of tags, 0.25 for their order, less 0.001 for each character after the last answer; 0 at least."""
    pair = lambda t: F.when(x.contains(f"<{t}>") & x.contains(f"</{t}>"), 0.125).otherwise(0.0)
    total = sum((pair(t) for t in TAGS if semantic or t != "semantic_elements"), F.lit(0.0))
    total = total - F.when(x.contains("</answer>"), F.length(strip(after_last(x, "</answer>"))) * 0.001).otherwise(0.0)
    end, start, middle = F.instr(x, "</think>"), F.instr(x, "<answer>"), F.instr(x, "<semantic_elements>")
    ordered = (end > 0) & (start > end)
    if semantic:
        ordered = ordered & (middle > end) & (start > middle)
    return F.greatest(F.lit(0.0), total + F.when(ordered, 0.25).otherwise(0.0))


#: Reward functions by name, each of (completion, answer).
REGISTRY = {
    "accuracy": lambda c, a: partial_accuracy(tag(c, "answer"), a),
    "exact": exact_accuracy,
    "symbolic": symbolic_accuracy,
    "length": lambda c, a: length_reward(tag(c, "think", F.lit(""))),
    "format": lambda c, a: format_reward(c),
    "tags": lambda c, a: tag_count_reward(c),
}


def weighted_sum(rewards: list[Column], weights: list[float]) -> Column:
    """Sum of weighted rewards in which a NaN makes the sum NaN and a null makes it null."""
    return sum((r.cast("double") * w for r, w in zip(rewards, weights)), F.lit(0.0))


def weighted_total(rewards: list[Column], weights: list[float]) -> Column:
    """Sum of weighted rewards where NaN and null count as 0."""
    return sum((F.coalesce(F.nanvl(r, F.lit(None).cast("double")) * w, F.lit(0.0)) for r, w in zip(rewards, weights)), F.lit(0.0))
