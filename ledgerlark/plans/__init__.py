"""Registered queries."""

from ledgerlark import registry
from ledgerlark.plans import aggregates, catalogue, entities, findings, landed, named, normalisers, paged, records, relational, retrieval, windows  # noqa: F401

registry.cast_oracle("two_stage_rollup", txns="BIGINT")
registry.cast_oracle("json_props", total="BIGINT")
registry.cast_oracle("two_level_coverage", direct="BIGINT", aggregated="BIGINT")
registry.cast_oracle("gazetteer_points", lon="DOUBLE", lat="DOUBLE")
registry.cast_oracle("geo_extras", w="DOUBLE", e="DOUBLE")
registry.cast_oracle("token_postings", tf="BIGINT")
registry.cast_oracle("conv_turns", chars="BIGINT")
registry.cast_oracle("additive_merge", ok="BIGINT", failed="BIGINT")
registry.cast_oracle("ods_catalogue", resource_count="INTEGER")
registry.cast_oracle("bespoke_catalogue", resource_count="INTEGER")
registry.cast_oracle("geonode_catalogue", w="DOUBLE", s="DOUBLE", e="DOUBLE", n="DOUBLE")
registry.cast_oracle("feature_pages", id="BIGINT", west="DOUBLE")
registry.cast_oracle("tolerant_csv", other="DOUBLE")
registry.cast_oracle("probe_files", rows="BIGINT")
registry.cast_oracle("sql_functions", amount="DOUBLE")
registry.cast_oracle("texts_by_beginning", chars="BIGINT")
