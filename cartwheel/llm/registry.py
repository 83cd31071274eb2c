"""Queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from cartwheel.llm import (byte_bpe, centroid_clusters, chat_format, decontaminate, jaccard_join, language_id, license_scan, line_dedup,
                           merkle_manifest, quality_rules, token_files, url_filter, warc_zip)
from cartwheel.llm.common import workers_import_package

MODULES = (url_filter, quality_rules, byte_bpe, token_files, jaccard_join, decontaminate, language_id, line_dedup,
           warc_zip, license_scan, centroid_clusters, chat_format, merkle_manifest)


def _with_package(query):
    def run(spark, sf_dir):
        workers_import_package(spark)
        return query(spark, sf_dir)
    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def llm_queries():
    return {name: _with_package(q) for m in MODULES for name, q in m.QUERIES.items()}


def llm_oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
