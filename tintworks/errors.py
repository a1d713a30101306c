"""Errors of the engine.

Checks of configurations raise at once.  Checks of rows are made inside the plan, by
`raising`, and come out of Spark as failures of a job; `translated` turns these back
into the errors below.
"""

import re
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F


class TintError(ValueError):
    """Base of all."""


class InvalidConfig(TintError):
    pass


class EmptyImage(TintError):
    pass


class NoValidPixels(TintError):
    pass


class ImageDecode(TintError):
    pass


class EmptySlots(TintError):
    pass


class EmptySamples(TintError):
    pass


class InvalidDomain(TintError):
    pass


class InvalidProblem(TintError):
    pass


class InvalidGroupTerm(TintError):
    pass


class EmptyFeasibleCap(TintError):
    pass


class InvalidRepresentative(TintError):
    pass


class NumericInstability(TintError):
    pass


class SolverFailure(TintError):
    pass


def raising(kind: type[TintError], *text: Column | str) -> Column:
    """A column that fails the job with an error of the kind given; the text may hold columns."""
    parts = [t if isinstance(t, Column) else F.lit(t) for t in (f"tintworks.{kind.__name__}: ", *text)]
    return F.raise_error(F.concat(*[p.cast("string") for p in parts]))


@contextmanager
def translated():
    """Jobs within the block that fail by `raising` raise the engine's own error."""
    try:
        yield
    except TintError:
        raise
    except Exception as failed:
        found = re.search(r"tintworks\.(?:errors\.)?(\w+): ([^\n]*)", str(failed))
        kind = globals().get(found.group(1)) if found else None
        if not (isinstance(kind, type) and issubclass(kind, TintError)):
            raise
        raise kind(found.group(2)) from failed
