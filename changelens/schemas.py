"""Explicit schemas of the relations that operators take and return."""

FILE_DIFF = "review_id string, file_ord long, file_path string, old_path string, new_file boolean, deleted_file boolean, renamed_file boolean, patch string"
POST_OUTCOME = "review_id string, ord int, file_path string, line int, status string, error string, attempts int, waited double"
REGISTRY = (
    "name string, root string, remote string, chunks long, indexed_at string, fileset array<string>, size_bytes long, "
    "root_exists boolean, reachable boolean"
)
