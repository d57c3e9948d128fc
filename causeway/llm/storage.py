"""Tables written to the folder that driver and executors share."""

from causeway.operators.storage import free_name, materialize, new_path, remove, shared_dir

__all__ = ["free_name", "materialize", "new_path", "remove", "shared_dir"]
