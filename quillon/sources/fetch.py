"""Pages from the web: one request at a time for a host, with a delay, a time-out and the configured headers."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import urls as U

# The pause before each request and the longest wait for an answer, in seconds.
DELAY, TIMEOUT = 0.15, 5.0


def http_get(url: str, user_agent: str = "quillon", referrer: str = "", timeout: float = TIMEOUT) -> tuple[int | None, str, str | None]:
    """(code, content, error) of a page. An HTTP error has its code and an empty content. A time-out has no code but its message as the error,
    anything else that fails the class of what happened."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": user_agent, **({"Referer": referrer} if referrer else {})})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return e.code, "", None
    except (OSError, ValueError) as e:
        reason = getattr(e, "reason", e)
        return None, "", str(reason) if isinstance(reason, TimeoutError) else f"Internal error: {type(reason).__name__}"


def fetch_pages(links: DataFrame, user_agent: str = "quillon", referrer: str = "", delay: float = DELAY, timeout: float = TIMEOUT) -> DataFrame:
    """(site_id, path, code, content, error) of links (site_id, path, link). A host's links go to one task, which pauses before each request."""

    def run(batches):
        for pdf in batches:
            out = []
            for site_id, path, link in zip(pdf["site_id"], pdf["path"], pdf["link"], strict=True):
                time.sleep(delay)
                out.append((site_id, path, *http_get(link, user_agent, referrer, timeout)))
            got = pd.DataFrame(out, columns=["site_id", "path", "code", "content", "error"])
            yield got.astype({"code": "Int32"})

    by_host = links.select("site_id", "path", "link").repartition(U.domain_link(F.col("link")))
    return by_host.mapInPandas(run, "site_id int, path string, code int, content string, error string")
