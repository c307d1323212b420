"""What the tests of the training-data operators share."""

from .conftest import SCHEMA, rows_of, sentence  # noqa: F401
