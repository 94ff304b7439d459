"""Intermediate tables in the folder that all executors share; see ``attesta.storage``."""

from __future__ import annotations

from attesta.storage import delete, drop, folder, new_path, save

__all__ = ["delete", "drop", "folder", "new_path", "save"]
