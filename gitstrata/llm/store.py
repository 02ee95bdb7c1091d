"""Intermediate tables of this subpackage; see ``gitstrata.shared``."""

from gitstrata.shared import delete, drop, new_path, shared_dir, written

__all__ = ["delete", "drop", "new_path", "shared_dir", "written"]
