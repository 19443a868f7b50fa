"""Small documents, built by the library."""

from quire.formats.build import *  # noqa: F403
