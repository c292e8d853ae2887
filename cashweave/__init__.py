"""cashweave: Spark-native append-only transaction ledger analytics.

Everything here takes and returns DataFrames. Clocks (``today``, ``now``), batch ids and
configuration values are explicit arguments so that a run can be repeated exactly.

Main entry points::

    from cashweave import (append_events, write_events, latest_state, current_state_from_ledger,
                           active_state, monthly_cashflow, summarize_months, top_merchants,
                           list_transaction_details, transaction_versions, diagnostics,
                           integrity_report, verify_hash_chain, redact_documents, secret_scan)
"""

from cashweave.operators.audit import diagnostics, integrity_report, verify_hash_chain
from cashweave.operators.details import list_transaction_details, transaction_versions
from cashweave.operators.ledger import append_events, append_history, write_events
from cashweave.operators.observations import append_account_observations
from cashweave.operators.privacy_jobs import redact_documents, secret_scan
from cashweave.operators.reports import monthly_cashflow, summarize_months, top_merchants
from cashweave.operators.state import (active_state, current_state, current_state_from_ledger, latest_state,
                                       refresh_latest_state)
from cashweave.session import build_session, checkpoint_dir, tune, tuned

__all__ = [
    "active_state", "append_account_observations", "append_events", "append_history", "build_session",
    "checkpoint_dir", "current_state", "current_state_from_ledger", "diagnostics", "integrity_report",
    "latest_state", "list_transaction_details", "monthly_cashflow", "redact_documents", "refresh_latest_state",
    "secret_scan", "summarize_months", "top_merchants", "transaction_versions", "tune", "tuned", "verify_hash_chain",
    "write_events",
]
