"""Stored tables of one operator, deleted as soon as nothing reads them any more."""

from hushframe.session import Scratch  # noqa: F401
