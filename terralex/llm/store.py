"""Tables written to the shared folder to cut lineage: they outlive a lost executor."""

from ..sources.scratch import Shelf

__all__ = ["Shelf"]
