"""Landing of remote snapshots: small driver-side jobs that write files which the readers then load."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import date, datetime, timezone

from waylake.sources.files import SourceError
from waylake.sources.sinks import deterministic_gzip, sha256

HEADERS = {"User-Agent": "waylake", "Accept": "application/json,text/html"}


def fetch(url: str, timeout: float = 30.0, attempts: int = 4, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body of a URL. Network failures are tried again after 1, 2, 4, 4 ... seconds; another status than 200 fails at once."""
    for attempt in range(attempts):
        try:
            with opener(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as response:
                if response.status != 200:
                    raise SourceError(f"{url}: status {response.status}")
                return response.read()
        except urllib.error.HTTPError as e:
            raise SourceError(f"{url}: status {e.code}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt + 1 == attempts:
                raise SourceError(f"{url}: {e}") from e
            sleep(min(2**attempt, 4))
    raise SourceError(f"{url}: no attempts")


def cutoff_in(page: bytes | str) -> str:
    """The date written in Chinese on a version page, as ISO text."""
    text = page.decode("utf-8") if isinstance(page, bytes) else page
    found = re.search(r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", re.sub(r"<[^>]+>", "", text))
    if not found:
        raise SourceError("no date on the version page")
    return date(*map(int, found.groups())).isoformat()


def land_snapshot(directory: str, urls: dict[str, str], version_url: str, expected_cutoff: str, get: Callable[[str], bytes] = fetch) -> dict:
    """Fetch every source and publish them, gzipped and with a manifest, as one new directory, or nothing at all."""
    if os.path.exists(directory):
        raise SourceError(f"{directory} exists")
    page = get(version_url)
    if cutoff_in(page) != expected_cutoff:
        raise SourceError(f"the version page says {cutoff_in(page)}, not {expected_cutoff}")
    parent = os.path.dirname(os.path.abspath(directory))
    os.makedirs(parent, exist_ok=True)
    staging = tempfile.mkdtemp(dir=parent, prefix=".staging-")
    try:
        entries = []
        for code, url in sorted(urls.items()):
            payload = get(url)
            packed = deterministic_gzip(payload)
            name = f"{code}.json.gz"
            with open(os.path.join(staging, name), "wb") as f:
                f.write(packed)
            entries.append({"province_code": code, "url": url, "filename": name, "payload_sha256": sha256(payload), "payload_size_bytes": len(payload), "archive_sha256": sha256(packed), "archive_size_bytes": len(packed)})
        manifest = {"schema_version": 1, "source_cutoff": expected_cutoff, "retrieved_at_utc": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "version_page": {"url": version_url, "sha256": sha256(page), "size_bytes": len(page)}, "sources": entries}
        with open(os.path.join(staging, "manifest.json"), "w", encoding="utf-8") as f:
            json.dump(manifest, f, ensure_ascii=False, indent=2, sort_keys=True)
            f.write("\n")
        os.rename(staging, directory)
        return manifest
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


def revision(repository: str, fallback: str | None = None) -> str | None:
    """The commit that a repository is at, or the fallback where that can't be asked."""
    try:
        done = subprocess.run(["git", "-C", repository, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
        return done.stdout.strip() or fallback
    except (OSError, subprocess.SubprocessError):
        return fallback
