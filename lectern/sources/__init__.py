from lectern.sources.shared import collected, discard, fresh_path, remove, shared_dir, stored
from lectern.sources.tables import table

__all__ = ["collected", "discard", "fresh_path", "remove", "shared_dir", "stored", "table"]
