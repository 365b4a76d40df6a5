from featlens.sources.readers import (  # noqa: F401
    TABLES, load_csv, nested_json_rows, preview, scan_attributes, table)
from featlens.sources.sinks import (  # noqa: F401
    feature_rows, save_models, wide_matrix, write_csv, write_matrix_csv)
