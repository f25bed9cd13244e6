"""Risk scores from weak signals."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_SCORE = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
SYNTHETIC_RISK, PRE_PATCH_RISK, POST_PATCH_RISK, TAINT_RISK = 0.9, 0.8, 0.2, 0.7

SIGNAL_SETS = {
    "weak": {"bandit"},
    "patch": {"patch"},
    "synthetic": {"synthetic"},
    "full": {"bandit", "patch", "synthetic"},
}


def _off(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def severity_score(severity: Column) -> Column:
    """Score of one severity name, 0 for any other."""
    out = F.lit(0.0)
    for name, score in reversed(SEVERITY_SCORE.items()):
        out = F.when(F.upper(severity) == name, score).otherwise(out)
    return out


def risk_score(
    bandit_score: Column, patched: Column, post_patch: Column, synthetic: Column,
    use: set[str] = SIGNAL_SETS["full"],
) -> Column:
    """Synthetic before patch before static analyser; ``use`` switches signals off for ablation."""
    out = F.lit(0.0)
    if "bandit" in use:
        out = F.when(bandit_score > 0, bandit_score).otherwise(out)
    if "patch" in use:
        patch = F.when(_off(post_patch), POST_PATCH_RISK).otherwise(PRE_PATCH_RISK)
        out = F.when(_off(patched), patch).otherwise(out)
    if "synthetic" in use:
        out = F.when(_off(synthetic), SYNTHETIC_RISK).otherwise(out)
    return out


def label_risk_score(
    explicit: Column, bandit_score: Column, patched: Column, post_patch: Column, synthetic: Column
) -> Column:
    """Label-time order: explicit, analyser score if present, patch, synthetic, else 0."""
    patch = F.when(_off(post_patch), POST_PATCH_RISK).otherwise(PRE_PATCH_RISK)
    return F.coalesce(
        explicit, bandit_score, F.when(_off(patched), patch),
        F.when(_off(synthetic), SYNTHETIC_RISK), F.lit(0.0),
    )
