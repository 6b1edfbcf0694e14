"""Prompt text for an external classifier, and parsing of its JSON answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataprobe.functions.draws import as_column, seeded_uniform

# The wording of the few-shot classification prompt.
PROMPT_TEMPLATE = """You will be provided with the following information:
1. An arbitrary text sample. The sample is delimited with triple backticks.
2. List of categories the text sample can be assigned to. The list is delimited with square brackets. The categories in the list are enclosed in the single quotes and comma separated.
3. Examples of text samples and their assigned categories. The examples are delimited with triple backticks. The assigned categories are enclosed in a list-like structure. These examples are to be used as training data.

Perform the following tasks:
1. Identify to which category the provided text belongs to with the highest probability.
2. Assign the provided text to that category.
3. Provide your response in a JSON format containing a single key `label` and a value corresponding to the assigned category. Do not provide any additional information except the JSON.

List of categories: {classes}

Training data:
{context}

Text sample: ```{question}```

Your JSON response:"""


def class_list(classes: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{c}'" for c in classes) + "]"


def prompt_parts(classes: Sequence[str]) -> tuple[str, str, str]:
    """The three literal stretches of the prompt around the examples and the question."""
    head, rest = PROMPT_TEMPLATE.replace("{classes}", class_list(classes)).split("{context}")
    middle, tail = rest.split("{question}")
    return head, middle, tail


def example_block(text, label) -> Column:
    return F.concat(F.lit("```"), as_column(text), F.lit("```\nassigned category: ['"), as_column(label), F.lit("']"))


def prompt(question, context, classes: Sequence[str]) -> Column:
    head, middle, tail = prompt_parts(classes)
    return F.concat(F.lit(head), as_column(context), F.lit(middle), as_column(question), F.lit(tail))


def parse_response(response, classes: Sequence[str], seed: int, key) -> Column:
    """0/1 label of a JSON answer; a broken answer or unknown class falls back to a keyed coin flip."""
    label = F.from_json(as_column(response), "label string").getField("label")
    guess = F.when(seeded_uniform(seed, key, F.lit("answer")) < 0.5, 0).otherwise(1)
    known = F.coalesce(label.isin(list(classes)), F.lit(False))
    return F.when(known, F.when(label == classes[-1], 1).otherwise(0)).otherwise(guess).cast("int")
