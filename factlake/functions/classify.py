"""Which paths are volatile: globs, of which any match counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """``*`` is any run of characters, dots too, ``?`` any one; all else is literal."""

    volatile: tuple[str, ...] = ()

    def pattern(self) -> str:
        wild = {"*": ".*", "?": "."}
        one = lambda glob: "".join(wild.get(c) or re.sub(r"([^\w\s])", r"\\\1", c, flags=re.ASCII) for c in glob)
        return r"(?s)\A(?:" + "|".join(map(one, self.volatile)) + r")\z"

    def is_volatile(self, path: str) -> bool:
        return bool(self.volatile) and re.match(self.pattern().replace(r"\z", r"\Z"), path) is not None

    def column(self, path: Column) -> Column:
        return path.rlike(self.pattern()) if self.volatile else F.lit(False)
