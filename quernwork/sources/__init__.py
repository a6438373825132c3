"""Where tables come from and where results go."""

from quernwork.sources.shared import ensure_checkpoint_dir, new_folder
from quernwork.sources.sinks import bucketed, dropped, partitioned
from quernwork.sources.tables import Tables

__all__ = ["Tables", "bucketed", "dropped", "ensure_checkpoint_dir", "new_folder", "partitioned"]
