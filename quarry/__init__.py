"""quarry: sample triage, clustering and training-set curation on Spark.

Every public operator is DataFrame-in, DataFrame-out (or Column-in,
Column-out for scalar functions).  Model outputs (logits, embeddings,
generated text) arrive as input columns; nothing here runs a model.
"""

from quarry.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
