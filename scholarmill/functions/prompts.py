"""Prompts for model plug-ins, and what is taken from their answers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def few_shot(item: Column, examples: list[tuple[str, str]], task: str = "Extract the title of the cited work.") -> Column:
    """A prompt with worked examples, the item and an open title line; the examples are the caller's. Null gives null."""
    shots = "".join(f"Item: {a}\nTitle: {b}\n\n" for a, b in examples)
    return F.concat(F.lit(f"{task}\n\n{shots}Item: "), item, F.lit("\nTitle:"))


def first_line(answer: Column) -> Column:
    """The first line of an answer."""
    return F.substring_index(answer, "\n", 1)


def spaced_markers(c: Column) -> Column:
    """A blank inside the reference markers."""
    return F.replace(F.replace(c, F.lit("<|reference_start|>"), F.lit("<|reference_start|> ")), F.lit("<|reference_end|>"), F.lit(" <|reference_end|>"))
