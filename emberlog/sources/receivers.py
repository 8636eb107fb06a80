"""Lines from the network into files that growing_files reads: what was received is kept before it is worked on.

Any number of processes listen and append, each to files of its own in one folder that they and Spark share; Spark
reads the folder as it reads any log files, with its offsets and restarts. What comes while a file is being forced to disk
is written together next, so the rate doesn't hang on one force for each line.
"""

from __future__ import annotations

import os
import queue
import socket
import socketserver
import threading
from concurrent.futures import Future
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

#: Receipts that wait to be written, at most; senders wait beyond that, and bytes of a file that are forced to disk at once, about.
WAITING, TOGETHER = 10_000, 1 << 20


class Spool:
    """Numbered files of whole lines in a folder; a full one is never renamed or written again.

    The files of a process bear its host and number, and it never appends to one that was there before: a line that a
    killed process left unfinished stays the end of its file, which no reader gives out. Lines that weren't acknowledged may be
    there all the same: a sender that repeats them has them twice.
    """

    def __init__(self, folder: str | Path, name: str, most_bytes: int = 64 << 20):
        self.folder, self.most_bytes = Path(folder), most_bytes
        self.name = f"{name}-{socket.gethostname()}-{os.getpid()}"
        self.folder.mkdir(parents=True, exist_ok=True)
        self.number = max((int(f.stem.rsplit("-", 1)[1]) for f in self.folder.glob(f"{self.name}-*.log")), default=0)
        self.waiting: queue.Queue[tuple[bytes, Future] | None] = queue.Queue(WAITING)
        self.file, self.size = None, 0
        self.writer = threading.Thread(target=self._write, daemon=True)
        self.writer.start()

    def add(self, raw: bytes, *, wait: bool = True) -> None:
        """The lines of some bytes that aren't empty; bytes that are no UTF-8 are replaced. wait: until they are on disk; raises OSError if they don't get there."""
        lines = [line for line in raw.decode("utf-8", "replace").splitlines() if line]
        if not lines:
            return
        done = Future()
        self.waiting.put(("".join(f"{line}\n" for line in lines).encode(), done))
        if wait:
            done.result()

    def close(self) -> None:
        """Write what waits, and no more."""
        self.waiting.put(None)
        self.writer.join()

    def _write(self) -> None:
        going = True
        while going:
            taken, size = [self.waiting.get()], 0
            while taken[-1] is not None and (size := size + len(taken[-1][0])) < TOGETHER:
                try:
                    taken.append(self.waiting.get_nowait())
                except queue.Empty:
                    break
            going = taken[-1] is not None
            told = [x for x in taken if x is not None]
            failed = None
            try:
                if told:
                    self._keep(b"".join(data for data, _ in told))
            except OSError as e:
                # what comes next goes to a new file, as this one may end in half a line
                failed, self.size = e, self.most_bytes + 1
            for _, done in told:
                done.set_exception(failed) if failed else done.set_result(None)
        if self.file:
            self.file.close()

    def _keep(self, data: bytes) -> None:
        if self.file is None or self.size > self.most_bytes:
            if self.file:
                self.file.close()
            self.file, self.size = None, 0
            while self.file is None:
                self.number += 1
                try:
                    self.file = open(self.folder / f"{self.name}-{self.number:09}.log", "xb")  # noqa: SIM115
                except FileExistsError:
                    continue
        self.file.write(data)
        self.file.flush()
        os.fsync(self.file.fileno())
        self.size += len(data)


def udp(spool: Spool, host: str = "0.0.0.0", port: int = 514) -> socketserver.BaseServer:
    """Each datagram's lines. Nobody is told of a datagram, so none waits for the disk."""

    class Datagram(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            spool.add(self.request[0], wait=False)

    server = socketserver.UDPServer((host, port), Datagram)
    server.max_packet_size = 65535
    # what comes while another thread is at work waits in the kernel, as far as that allows
    server.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 16 << 20)
    return server


def tcp(spool: Spool, host: str = "0.0.0.0", port: int = 514) -> socketserver.BaseServer:
    """Lines of connections; the last one counts without an end too. A sender that is faster than the disk is held up."""

    class Connection(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for line in self.rfile:
                spool.add(line, wait=False)

    server = socketserver.ThreadingTCPServer((host, port), Connection)
    server.daemon_threads = True
    return server


def http(spool: Spool, host: str = "0.0.0.0", port: int = 4318) -> ThreadingHTTPServer:
    """Bodies of POST requests: JSON records, one for each line. 200 says that they are on disk.

    A body comes with its length or in chunks; without either it is 411, one that breaks off 400, one larger than a
    file 413, and 503 where the disk takes no more.
    """

    class Request(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            self.send_response(self._received())
            self.end_headers()

        def _received(self) -> int:
            try:
                if "chunked" in (self.headers.get("Transfer-Encoding") or "").lower():
                    body = self._chunks()
                elif (length := self.headers.get("Content-Length")) is None:
                    return 411
                else:
                    body = self._exactly(int(length)) if int(length) <= spool.most_bytes else None
            except ValueError:
                return 400
            if body is None:
                return 413
            try:
                spool.add(body)
            except OSError:
                return 503
            return 200

        def _exactly(self, n: int) -> bytes:
            if n < 0 or len(found := self.rfile.read(n)) != n:
                raise ValueError("broken off")
            return found

        def _chunks(self) -> bytes | None:
            parts, total = [], 0
            while n := int(self.rfile.readline(1000).split(b";")[0], 16):
                total += n
                if total > spool.most_bytes:
                    return None
                parts.append(self._exactly(n))
                self.rfile.readline(1000)
            while self.rfile.readline(65536).strip():
                pass
            return b"".join(parts)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Request)


def listen(servers: list[socketserver.BaseServer]) -> list[threading.Thread]:
    """Start them all; shutdown() of each ends its thread."""
    threads = [threading.Thread(target=s.serve_forever, daemon=True) for s in servers]
    for t in threads:
        t.start()
    return threads
