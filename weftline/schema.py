"""Schemas that sources and sinks share."""

LINES = "file string, line_no bigint, value string"
#: Column order of exported records.
PERF_COLUMNS = ["Threads", "BlockSize", "HackSize", "Time_s", "MFLOPS", "NNZ", "Matrix", "Format", "Mode", "GFLOPS"]
