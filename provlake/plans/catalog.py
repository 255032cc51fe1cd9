"""All registered queries."""

from provlake.plans import q_artifacts, q_evidence, q_ledger, q_policy, q_risk, q_streaming, q_sufficiency, q_taint  # noqa: F401
from provlake.plans.registry import ORACLES, QUERIES  # noqa: F401
