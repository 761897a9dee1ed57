"""Members of remote zip archives by ranges: only the directory at an archive's end is fetched."""

from __future__ import annotations

import io
import urllib.request
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RangeFile(io.RawIOBase):
    """A remote file, read where it is asked for with HTTP ranges."""

    def __init__(self, url: str, timeout: float = 60.0):
        self.url, self.timeout, self.at = url, timeout, 0
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:  # noqa: S310
            self.size = int(r.headers["Content-Length"])

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.size, self.at + n)
        if end <= self.at:
            return b""
        ask = urllib.request.Request(self.url, headers={"Range": f"bytes={self.at}-{end - 1}"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as r:  # noqa: S310
            out = r.read()
        if len(out) != end - self.at:
            raise OSError(f"{self.url}: asked for {end - self.at} bytes, got {len(out)}")
        self.at = end
        return out


def zip_members(rows: DataFrame, url: str = "url", suffix: str = ".tif") -> DataFrame:
    """``url, status, member, size``: members of every archive that end in ``suffix``; an archive that can't be read is one
    row whose status says why (300 characters)."""

    @F.udf("array<struct<status:string,member:string,size:long>>")
    def look(u):
        try:
            with zipfile.ZipFile(RangeFile(u)) as z:
                return [("ok", m.filename, m.file_size) for m in z.infolist() if m.filename.lower().endswith(suffix)]
        except Exception as e:  # noqa: BLE001
            return [(f"error: {e}"[:300], None, None)]

    return rows.select(url, F.explode(look(url)).alias("m")).select(url, "m.*")
