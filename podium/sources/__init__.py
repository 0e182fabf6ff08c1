from .pages import as_wide, embedded_series, html_links, html_tables, ranked_slugs
from .payloads import (catalogue_resources, community_candidates, preferred_resource, read_charts,
                       read_indicator_pages, resource_candidates, row_service_table, sidecar_unit)
from .ranged import changed_ranges, ranged_difference, read_ranged, write_ranged
from .readers import (read_delimited, read_json_table, read_jsonl, read_observations, read_table, read_zipped,
                      read_zipped_cells, upload_kind)
from .snapshots import snapshot_series
from .variants import (document_kinds, read_variants, variant_cells, variant_columns, variant_observations, variant_records,
                       variant_table)
from .writers import append_log, read_log, write_artefacts, write_dataset_csv, write_nested_json
