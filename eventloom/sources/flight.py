"""Tables of Arrow Flight endpoints as a Spark data source: a partition for each endpoint of a flight, record batches straight into Spark.

    spark.dataSource.register(FlightSource)
    spark.read.format("flight").option("location", "grpc://host:8815").option("path", "collection").load()
    df.write.format("flight").option("location", ...).option("path", ...).mode("append").save()

Options: ``token`` is sent as a bearer token, ``filter_tag`` as the ticket's or descriptor's filter of tags. The schema is the flight's own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from eventloom.session import reach
from eventloom.sources.warehouse import Source


def client(options: dict, location: str | None = None):
    """A client of the endpoint, and the call options that carry the token."""
    from pyarrow import flight

    headers = [(b"authorization", f"Bearer {options['token']}".encode())] if options.get("token") else []
    return flight.connect(location or options["location"]), flight.FlightCallOptions(timeout=float(options.get("timeout", 30)), headers=headers)


def descriptor(options: dict):
    """A path, or a command with the path and the tag to filter by."""
    from pyarrow import flight

    tag = options.get("filter_tag")
    return flight.FlightDescriptor.for_path(options["path"]) if tag is None else flight.FlightDescriptor.for_command(json.dumps({"path": options["path"], "filter_tag": tag}))


class FlightPartition(InputPartition):
    def __init__(self, ticket: bytes, location: str):
        self.ticket, self.location = ticket, location


class FlightReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        to, call = client(self.options)
        with to:
            info = to.get_flight_info(descriptor(self.options), call)
            return [FlightPartition(e.ticket.ticket, e.locations[0].uri.decode() if e.locations else self.options["location"]) for e in info.endpoints]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import flight

        to, call = client(self.options, partition.location)
        with to:
            for chunk in to.do_get(flight.Ticket(partition.ticket), call):
                if chunk.data is not None and chunk.data.num_rows:
                    yield chunk.data


class FlightWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        first = next(batches, None)
        if first is not None:
            to, call = client(self.options)
            with to:
                out, _ = to.do_put(descriptor(self.options), first.schema, call)
                with out:
                    out.write_batch(first)
                    for batch in batches:
                        out.write_batch(batch)
        return WriterCommitMessage()


class FlightSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flight"

    def schema(self) -> StructType:
        to, call = client(self.options)
        with to:
            return from_arrow_schema(to.get_flight_info(descriptor(self.options), call).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return FlightReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a flight is appended to")
        return FlightWriter(dict(self.options), schema)


def source(spark: SparkSession, location: str, **options: str) -> Source:
    """An endpoint to attach to a warehouse; its tables are the paths of its flights."""
    reach(spark)
    spark.dataSource.register(FlightSource)

    def tables() -> list[str]:
        to, call = client({"location": location} | options)
        with to:
            return sorted("/".join(p.decode() for p in f.descriptor.path) for f in to.list_flights(options=call))

    return Source(tables, lambda t: spark.read.format("flight").options(location=location, path=t, **options).load())


def send(df: DataFrame, location: str, path: str, **options: str) -> None:
    """Append the rows of ``df`` to a path of an endpoint, partition by partition. A task that is tried again may send its rows twice."""
    reach(df.sparkSession)
    df.sparkSession.dataSource.register(FlightSource)
    df.write.format("flight").options(location=location, path=path, **options).mode("append").save()
