"""FN-09: counts out of free text, such as `12k views, likes: 300 at 24h`."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of counts with the words for them, the units of durations in hours, words that say nothing.
NAMES = {
    "views": ("view", "views", "impression", "impressions", "imp"),
    "likes": ("like", "likes", "reaction", "reactions", "hearts", "heart"),
    "comments": ("comment", "comments", "reply", "replies"),
    "reposts": ("repost", "reposts", "reshare", "reshares", "retweet", "retweets", "rt", "rts", "share", "shares"),
    "saves": ("save", "saves", "bookmark", "bookmarks"),
    "follows": ("follow", "follows", "follower", "followers", "newfollowers"),
    "clicks": ("click", "clicks"),
    "profile_views": ("profileviews", "profile_views"),
}
HOURS = {1: ("h", "hr", "hrs", "hour", "hours"), 24: ("d", "day", "days"), 168: ("w", "wk", "week", "weeks")}
TIMES = {"": 1, "k": 1_000, "m": 1_000_000, "b": 1_000_000_000}
FILLERS, MARKS, LATER = ("and", "with", "of", "the", "a"), (":", "=", ",", ";", "·", "-", "—"), ("--after", "after", "at", "@")

_NAME = {word: name for name, words in NAMES.items() for word in words}
_UNIT = {unit: hours for hours, units in HOURS.items() for unit in units}
_TOKEN = re.compile(r"-{0,2}[A-Za-z_]+|\d[\d,]*(?:\.\d+)?[A-Za-z]*|\.\d+[A-Za-z]*|[^\sA-Za-z0-9]")
_NUMBER = re.compile(r"(\d[\d,]*(?:\.\d+)?|\.\d+)([kmb]?)")
_LENGTH = re.compile(r"(\d+(?:\.\d+)?)([a-z]+)")
_GLUED = re.compile(r"(\d[\d,]*(?:\.\d+)?[kmb]?)([a-z_]+)")


def number(token: str) -> int | None:
    m = _NUMBER.fullmatch(token.lower())
    return round(float(m[1].replace(",", "")) * TIMES[m[2]]) if m else None


def hours(token: str) -> int | None:
    m = _LENGTH.fullmatch(token.lower())
    return round(float(m[1]) * _UNIT[m[2]]) if m and m[2] in _UNIT else None


def name_of(word: str) -> str | None:
    word = word.lower().strip("_")
    return _NAME.get(word) or (_NAME.get(word[3:]) if word.startswith("new") else None)


class Counts:
    """The counts of a text, read from its tokens: a number waits for the name behind it, a name takes the number right behind it if none waits."""

    def __init__(self, text: str):
        self.metrics: dict[str, int] = {}
        self.unparsed: list[str] = []
        self.warnings: list[str] = []
        self.after: int | None = None
        self.waiting: str | None = None
        self.rest = deque(t for t in _TOKEN.findall(text) if t not in MARKS)
        while self.rest:
            self.take(self.rest.popleft())
        self.drop_waiting()

    def drop_waiting(self) -> None:
        if self.waiting is not None:
            self.unparsed.append(self.waiting)
        self.waiting = None

    def put(self, name: str, value: int) -> None:
        if self.metrics.get(name, value) != value:
            self.warnings.append(f"{name} given twice; keeping {value}")
        self.metrics[name] = value

    def duration_ahead(self) -> bool:
        """Takes `24h` or `7 days` off the rest, if it begins so."""
        for n in (1, 2):
            if len(self.rest) >= n and (found := hours("".join(self.rest[k] for k in range(n)))) is not None:
                self.after = found
                for _ in range(n):
                    self.rest.popleft()
                return True
        return False

    def take(self, token: str) -> None:
        low = token.lower()
        if low in LATER:
            if not self.duration_ahead() and low in LATER[:2]:
                self.unparsed.append(token)
        elif self.waiting is None and (length := hours(token)) is not None:
            self.after = length
        elif number(token) is not None:
            self.drop_waiting()
            self.waiting = token
        elif (name := name_of(token)) is not None:
            if self.waiting is not None:
                self.put(name, number(self.waiting))
                self.waiting = None
            elif self.rest and number(self.rest[0]) is not None:
                self.put(name, number(self.rest.popleft()))
            else:
                self.unparsed.append(token)
        elif (m := _GLUED.fullmatch(low)) and name_of(m[2]):
            self.put(name_of(m[2]), number(m[1]))
        elif low not in FILLERS:
            self.unparsed.append(token)


def parse_counts(text: Column | str) -> Column:
    """struct<metrics map<string,bigint>, after_hours, unparsed, warnings> of a text; the last value of a name counts. Null text gives null, a text without counts an empty map."""

    @F.pandas_udf("metrics map<string,bigint>, after_hours bigint, unparsed array<string>, warnings array<string>")
    def each(texts: pd.Series) -> pd.DataFrame:
        found = [Counts(t) if isinstance(t, str) else None for t in texts]
        rows = [(c.metrics, c.after, c.unparsed, c.warnings) if c else (None, None, None, None) for c in found]
        out = pd.DataFrame(rows, columns=["metrics", "after_hours", "unparsed", "warnings"])
        return out.astype({"after_hours": "Int64"})

    column = F.col(text) if isinstance(text, str) else text
    return F.when(column.isNotNull(), each(column))
