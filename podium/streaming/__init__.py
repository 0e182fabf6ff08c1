from .live import (append_stream, current_leaderboard, read_current, stream_cells, stream_daily_cells,
                   stream_name_year_sums,
                   write_current_tables)
from .deltas import batch_log, compact, late_rows, read_latest, stream_daily_best, stream_daily_sums, write_deltas
