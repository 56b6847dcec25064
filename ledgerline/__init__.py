"""ledgerline — account-ledger analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``ledger_id``; windows are
always partitioned by ledger and run on (ledger, month) aggregates, never on raw
movements.
"""

from ledgerline.session import get_session, checkpoint_dir  # noqa: F401
