"""Posting a body through a given transport, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable

Send = Callable[[str], tuple[int, str]]


def post(send: Send, body: str, what: str, retries: int = 3, first_wait: float = 0.25, longest_wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of ``send`` (body to status and answer); failures of transport, 429 and 5xx are tried again, waits double up to the longest."""
    wait = first_wait
    for left in range(retries, -1, -1):
        try:
            status, answer = send(body)
            problem = f"status {status}"
        except OSError as e:
            status, answer, problem = 0, "", str(e)
        if 200 <= status < 300:
            return answer
        if not left or (status and status != 429 and status < 500):
            raise RuntimeError(f"{what} failed: {problem}")
        sleep(wait)
        wait = min(2 * wait, longest_wait)
    raise AssertionError
