"""The reference processes static tables only; fitted operators here are stateless
column expressions plus one-row (or level-table) broadcasts, so they apply to a streaming
DataFrame unchanged (stream-static joins)."""

from featlens.streaming.apply import apply_fitted  # noqa: F401
