"""Label expressions: regex rules, class names, 0/1 encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataprobe.functions.draws import as_column


@dataclass(frozen=True)
class RuleSet:
    """A row is positive when any positive pattern is found and no negative pattern is."""

    positives: tuple[str, ...]
    negatives: tuple[str, ...] = ()

    @property
    def patterns(self) -> tuple[str, ...]:
        return self.positives + self.negatives

    def replace(self, index: int, pattern: str) -> "RuleSet":
        """The same rules with pattern number ``index`` (0-based, positives first) edited."""
        patterns = list(self.patterns)
        patterns[index] = pattern
        cut = len(self.positives)
        return RuleSet(tuple(patterns[:cut]), tuple(patterns[cut:]))


# The text rules of the depression-symptom labelling task, and the edited second rule.
SYMPTOM_RULES = RuleSet(
    positives=(
        r"(0|no|zero) (motivation|interest)",
        r"(lose|losing|lost)[^\n]{0,15} (interest|pleasure|motivation)",
    ),
    negatives=(r"recover[^\n]{0,15} from (0|no|zero) (motivation|interest)",),
)
SYMPTOM_EDITED_RULE = r"(lose|losing|lost)[^\n]{0,15} (pleasure|motivation)"
SYMPTOM_CLASSES = ("anhedonia", "regular")


def rule_hit(text, pattern: str) -> Column:
    """Case-sensitive regex search; a null text never matches."""
    return F.coalesce(as_column(text).rlike(pattern), F.lit(False))


def combine_rules(hits: Sequence[Column], n_positive: int) -> Column:
    """(p1 OR p2 ..) AND NOT (n1 OR n2 ..) over already evaluated rule columns."""
    any_of = lambda cols: reduce(lambda a, b: a | b, cols)
    label = any_of(list(hits[:n_positive]))
    negatives = list(hits[n_positive:])
    return label & ~any_of(negatives) if negatives else label


def rule_label(text, rules: RuleSet) -> Column:
    return combine_rules([rule_hit(text, p) for p in rules.patterns], len(rules.positives))


def class_name(label, true_name: str, false_name: str) -> Column:
    """Boolean label to its class name; null stays null."""
    c = as_column(label)
    return F.when(c, F.lit(true_name)).when(~c, F.lit(false_name))


def binarize(label, classes: Sequence) -> Column:
    """Two classes to 0/1; the class listed last is 1, a value in neither class is 0, null stays null."""
    if len(classes) != 2:
        raise ValueError("binarize takes exactly two classes")
    c = as_column(label)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.when(c == F.lit(classes[-1]), 1).otherwise(0)).cast("int")
