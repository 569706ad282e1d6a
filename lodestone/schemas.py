"""The tables of a code graph.

Numbers of rows are hashes of what names them, so that they are the same in every run and need no counter:
files by repository and path, symbols by file and place in it.
"""

from __future__ import annotations

IMPORT = "struct<source: string, names: array<string>, is_default: boolean, is_namespace: boolean, is_type_only: boolean, is_dynamic: boolean>"
EXPORT = "struct<name: string, is_default: boolean, is_re_export: boolean, source: string>"
SYMBOL = "struct<kind: string, name: string, signature: string, start_line: int, start_col: int, end_line: int, end_col: int, extends: string, implements: array<string>>"
PARSED = f"struct<imports: array<{IMPORT}>, exports: array<{EXPORT}>, symbols: array<{SYMBOL}>, error: string>"

TABLES = {
    "repos": "repo_id long, root_path string, created_at timestamp, updated_at timestamp",
    "files": "repo_id long, file_id long, path string, lang string, sha256 string, mtime double, size_bytes long, last_indexed_at timestamp",
    "contents": "repo_id long, file_id long, path string, text string",
    "parsed": f"repo_id long, file_id long, path string, imports array<{IMPORT}>, exports array<{EXPORT}>, warning string",
    "symbols": "repo_id long, file_id long, symbol_id long, ord int, kind string, name string, fq_name string, signature string, start_line int, start_col int, end_line int, end_col int, extends string, implements array<string>",
    "modules": "repo_id long, module_id long, name string, version string, manifest_path string",
    "edges": "repo_id long, src_type string, src_id long, rel string, dst_type string, dst_id long, meta_json string, weight double, file_id long, ord int",
    "search_index": "repo_id long, entity_type string, entity_id long, text string",
    "listing": "repo_id long, path string, is_dir boolean",
}

NODE_TYPES = ("file", "symbol", "module")
EDGE_KINDS = ("IMPORTS", "EXPORTS", "DEFINES", "REFERENCES", "EXTENDS", "IMPLEMENTS", "TESTS")
