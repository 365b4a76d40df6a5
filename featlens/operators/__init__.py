"""DataFrame -> DataFrame operators; fitted state is kept in small DataFrames or dataclasses."""
