"""Column masking and row access policies as DataFrame projections.

Spark has no role catalog, so the caller's role is a plain argument. Both
policies compile to a constant-folded expression (the role is a literal), so a
masked column costs nothing at runtime and an admin row policy disappears from
the plan entirely.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Roles are plain arguments; these are the names the queries use.
ADMIN_ROLE = "admin"
AGENT_ROLE = "agent"
ANALYST_ROLE = "analyst"
MASK_TOKEN = "***"


@dataclass(frozen=True)
class MaskingPolicy:
    """Value for the listed roles, otherwise the mask token (NULL masks too)."""
    allowed_roles: tuple[str, ...] = (ADMIN_ROLE, ANALYST_ROLE)
    mask: str = MASK_TOKEN


@dataclass(frozen=True)
class RowAccessPolicy:
    """Rows where ``flag_col`` is TRUE, or every row for a bypass role.

    A NULL flag is not TRUE, so such rows stay hidden from non-bypass roles.
    """
    flag_col: str = "is_active"
    bypass_roles: tuple[str, ...] = (ADMIN_ROLE,)


MEMBER_HASH_MASK = MaskingPolicy()
ACTIVE_KB_ONLY = RowAccessPolicy()


def apply_masks(df: DataFrame, policies: dict[str, MaskingPolicy], role: str) -> DataFrame:
    """Replace each policed column by its masked form for ``role``."""
    out = df
    for column, policy in policies.items():
        visible = F.lit(role).isin(*policy.allowed_roles)
        out = out.withColumn(column, F.when(visible, F.col(column)).otherwise(F.lit(policy.mask)))
    return out


def apply_row_policy(df: DataFrame, policy: RowAccessPolicy, role: str) -> DataFrame:
    if role in policy.bypass_roles:
        return df
    return df.where(F.coalesce(F.col(policy.flag_col) == F.lit(True), F.lit(False)))
