"""The library's encoders, which are written apart from its decoders."""

from quire.formats.encoders import *  # noqa: F403
