"""Helpers of the tests."""


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: [(v is None, str(v)) for v in r])
