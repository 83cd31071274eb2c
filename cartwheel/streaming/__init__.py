from cartwheel.streaming.reports import (  # noqa: F401
    StreamedReport, read_stream, start_report, windowed_counts,
)
