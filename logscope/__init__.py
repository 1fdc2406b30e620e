"""logscope: conversation-log ingest, upsert and search as Spark jobs.

Everything is DataFrame / SQL expressions; there is no Python UDF in the core.
"""

from logscope.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
