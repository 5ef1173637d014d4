"""Reading and writing files of an array store, local or remote (s3://, gs://, hdfs://, file://), with byte counts."""

from __future__ import annotations

import os

import pyarrow.fs as pafs

REMOTE = ("s3://", "s3a://", "gs://", "gcs://", "hdfs://", "abfs://", "abfss://")


def is_remote(path: str) -> bool:
    return path.lower().startswith(REMOTE)


#: Environment variables that name credentials of the usual chain besides keys.
S3_CHAIN = ("AWS_PROFILE", "AWS_ROLE_ARN", "AWS_WEB_IDENTITY_TOKEN_FILE", "AWS_CONTAINER_CREDENTIALS_RELATIVE_URI", "AWS_CONTAINER_CREDENTIALS_FULL_URI", "AWS_SHARED_CREDENTIALS_FILE")


def unsigned(options: dict, has_keys: bool, names: tuple[str, ...], file: str) -> bool:
    """Whether requests go without credentials; an instance's own role needs anonymous=false, as nothing here shows it."""
    told = str(options.get("anonymous", "")).lower()
    if told in ("true", "false"):
        return told == "true"
    return not (has_keys or any(os.environ.get(n) for n in names) or os.path.exists(os.path.expanduser(file)))


def filesystem(path: str, options: dict | None = None) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it).  The option `anonymous` (true or false) decides; without it, keys in options or the
    environment, then any other source the usual chain names (profile, role, token, instance or container), else none.
    """
    options = {k.lower(): v for k, v in (options or {}).items()}
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith(("s3://", "s3a://")):
        kind = {k: options.get(k) or os.environ.get(e) for k, e in (("access_key", "AWS_ACCESS_KEY_ID"), ("secret_key", "AWS_SECRET_ACCESS_KEY"), ("session_token", "AWS_SESSION_TOKEN"), ("region", "AWS_DEFAULT_REGION"), ("endpoint_override", "AWS_ENDPOINT_URL"))}
        kind = {k: v for k, v in kind.items() if v}
        return pafs.S3FileSystem(anonymous=unsigned(options, "access_key" in kind, S3_CHAIN, "~/.aws/credentials"), **kind), path.split("://", 1)[1]
    if path.startswith(("gs://", "gcs://")):
        anonymous = unsigned(options, bool(options.get("credentials")), ("GOOGLE_APPLICATION_CREDENTIALS",), "~/.config/gcloud/application_default_credentials.json")
        return pafs.GcsFileSystem(anonymous=anonymous), path.split("://", 1)[1]
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


class Store:
    """Files under one root. `bytes_read` counts what was fetched."""

    def __init__(self, path: str, options: dict | None = None):
        self.path = path.rstrip("/")
        self.fs, self.root = filesystem(self.path, options)
        self.root = self.root.rstrip("/")
        self.bytes_read = 0

    def children(self) -> list[str]:
        """Names of the folders directly below the root, sorted."""
        try:
            found = self.fs.get_file_info(pafs.FileSelector(self.root))
        except FileNotFoundError:
            raise FileNotFoundError(f"no array store at {self.path!r}") from None
        return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory)

    def get(self, name: str) -> bytes | None:
        """Content of a file, None if there is none."""
        try:
            with self.fs.open_input_file(f"{self.root}/{name}") as f:
                data = f.read()
        except (FileNotFoundError, IsADirectoryError):
            return None
        self.bytes_read += len(data)
        return data

    def put(self, name: str, data: bytes) -> None:
        full = f"{self.root}/{name}"
        self.fs.create_dir(full.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(full) as f:
            f.write(data)
