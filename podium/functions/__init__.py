"""Column expressions; none of them is a Python UDF."""

from .dates import (display_label, frequency_of_hint, infer_frequency, is_calendar_date, leading_year,
                    looks_like_date, parse_date, year_label)
from .text import (alias_name, ascii_slug, canonical_key, cell_names, clean, compact_number, content_hash,
                   dataset_hash, fetched_table_unit, flag_emoji, format_spec_value, format_value, has_real_flag, indicator_unit,
                   matched, month_day_hint, norm_key, prefixed_slug, rank_direction, record_hash, scaled_number,
                   slugify, squeeze, strip_corporate_suffix, table_unit, top_n_wanted, topics, year_range)
from .units import convert_known, convert_unit, normalize_unit, unit_word
from .urls import dataset_ref, extract_urls, host_authority, host_of, normalise_url, publisher_key
