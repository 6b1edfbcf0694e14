"""Rule-based weak labels, and their incremental maintenance when a rule is edited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.labels import RuleSet, class_name, combine_rules, rule_hit
from dataprobe.operators.keyed import label_symdiff, patch_rows
from dataprobe.schemas import require


def rule_columns(rules: RuleSet) -> list[str]:
    return [f"rule_{i + 1}" for i in range(len(rules.patterns))]


def join_users_tweets(users: DataFrame, tweets: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Texts of the users in the given countries; duplicate user ids fan out as in any inner join."""
    require(users, "join_users_tweets", "user_id", "country")
    require(tweets, "join_users_tweets", "user_id", "tweet")
    kept = users.filter(F.col("country").isin(countries)) if countries is not None else users
    return kept.join(tweets, "user_id", "inner")


def weak_label(
    df: DataFrame, text: str, rules: RuleSet, label: str = "label", classes: tuple[str, str] | None = None
) -> DataFrame:
    """Add one boolean column per rule and the combined label; one projection, batch or stream.

    The rule columns stay on the table: an edit of one rule then needs only that rule run again.
    """
    require(df, "weak_label", text)
    names = rule_columns(rules)
    hit = df.withColumns({n: rule_hit(text, p) for n, p in zip(names, rules.patterns)})
    out = hit.withColumn(label, combine_rules([F.col(n) for n in names], len(rules.positives)))
    if classes is not None:
        out = out.withColumn("class_name", class_name(label, *classes))
    return out


def label_diff(
    labelled: DataFrame, key: str, text: str, old: RuleSet, edited: int, pattern: str, label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """After rule number ``edited`` became ``pattern``: (changed rows with new labels, whole table).

    ``labelled`` must come from ``weak_label(.., old)``.  Only the edited rule is evaluated; the stored
    columns of the other rules are reused.  The first table has the rows on which that *rule* flipped,
    with ``old_label`` next to the new one.
    """
    names = rule_columns(old)
    require(labelled, "label_diff", key, text, label, *names)
    fresh = labelled.withColumn("_fresh", rule_hit(text, pattern))
    moved = label_symdiff(fresh, names[edited], "_fresh")
    hits = [F.col("_fresh") if i == edited else F.col(n) for i, n in enumerate(names)]
    new_label = combine_rules(hits, len(old.positives))
    diff = moved.select(
        *[c for c in labelled.columns if c not in (label, names[edited])],
        F.col("_fresh").alias(names[edited]),
        F.col(label).alias("old_label"),
        new_label.alias(label),
    )
    # The old row already holds every other rule, so the patch is a projection and needs no join.
    patched = fresh.withColumns({names[edited]: F.col("_fresh"), label: new_label}).select(labelled.columns)
    return diff, patched


def patch_labels(labelled: DataFrame, diff: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Fold a stored diff into a stored table, by id."""
    return patch_rows(labelled, diff, key, label)
