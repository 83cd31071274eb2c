from cartwheel.sources.csv import load_csv, load_csv_inferred, write_csv  # noqa: F401
from cartwheel.sources.schemas import SHOP_SCHEMAS  # noqa: F401
from cartwheel.sources.shop import duplicate_keys, ingest_csv, normalise_dimensions, read_shop_tables  # noqa: F401
