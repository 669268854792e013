"""What the engine offers by name: ingestion, listing, search, comparison and deletion over a catalog."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import embedding as E
from lodestone.functions import images as I
from lodestone.functions import text as X
from lodestone.operators import dml, extract, knn, numbering, search
from lodestone.operators import joins as J
from lodestone.plans import compare as C

# Category by default, placeholder of a record without a description, accepted distance.
CLIENT = "CLIENT"
CATEGORY, NO_DESCRIPTION, IMAGE_DISTANCE, IMAGE_K = "MYIPO", "Extracted from PDF", 0.10, 10
MARKS, CLIENTS, USERS = "trademarks", "client_trademarks", "users"


class Engine:
    """The tables of a catalog and the queries over them."""

    def __init__(self, catalog: dml.Catalog):
        self.catalog = catalog
        for name, s in ((MARKS, schema.MARKS), (CLIENTS, schema.CLIENTS), (USERS, schema.USERS)):
            catalog.create(name, s)

    def marks(self) -> DataFrame:
        return self.catalog.read(MARKS)

    def clients(self) -> DataFrame:
        return self.catalog.read(CLIENTS)

    # ------------------------------------------------------------------- writing

    def ingest_journal(self, words: DataFrame, category: str = CATEGORY, batch: str | None = None, year: str | None = None, start_page: int = 4) -> int:
        """Extract the records of a journal's pages, embed and upsert them; the new version of the table.

        The text is embedded as extracted; what is stored has its class boilerplate dropped.
        """
        found = extract.records(words, start_page)
        # Numbered in the order of the pages, so that ids of new rows are dense and never meet.
        rows = numbering.numbered(found, ["doc_id", "page", "class_y"], self._work("numbers"))
        rows = rows.withColumn("text_embedding", E.text_embedding(X.combined(F.col("trademark_name"), F.col("description")))).withColumn("description", X.scrubbed(F.col("description")))
        filled = {"category": F.lit(category), "batch_number": F.lit(batch), "batch_year": F.lit(year), "is_split": F.lit(False), "created_at": F.current_timestamp()}
        for field in schema.MARKS:
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, filled.get(field.name, F.lit(None)).cast(field.dataType))
        return self.catalog.upsert(MARKS, rows.select("seq", *[f.name for f in schema.MARKS if f.name != "id"]))

    def ingest_clients(self, rows: DataFrame, file_name: str, upload_date: Column | None = None) -> int:
        """Append client records (logo_data, logo_embedding, applicant_name, description); gaps are filled from the file."""
        top = self.clients().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        wanted = ["logo_data", "logo_embedding", "applicant_name", "description"]
        made = numbering.numbered(rows.select(*wanted), ["applicant_name", "description"], self._work("numbers"), "id", top + 1).select(
            "id", F.lit(file_name).alias("file_name"), "logo_data", "logo_embedding",
            X.first_filled(F.col("applicant_name"), default=file_name).alias("applicant_name"), X.first_filled(F.col("description"), default=NO_DESCRIPTION).alias("description"),
            (F.lit(None) if upload_date is None else upload_date).cast("timestamp_ntz").alias("upload_date"),
        )
        return self.catalog.insert(CLIENTS, made)

    def _work(self, name: str) -> str:
        """A new folder beside the tables for what a change has to write first."""
        return f"{self.catalog.root}/_work/{name}-{uuid.uuid4().hex}"

    def add_user(self, rows: DataFrame) -> int:
        """Insert users; one whose name or address is taken raises ValueError."""
        return self.catalog.insert(USERS, rows, unique=("username", "email"))

    def set_role(self, user_id: int, role: str) -> int:
        return self.catalog.update(USERS, F.col("id") == user_id, role=F.lit(role))

    def delete_user(self, user_id: int) -> int:
        return self.catalog.delete(USERS, self._ids([user_id]))

    def user_by_email(self, email: str) -> DataFrame:
        return self.catalog.read(USERS).where(F.col("email") == email)

    def users(self) -> DataFrame:
        return self.catalog.read(USERS).select("id", "username", "email", "role").orderBy("id")

    def set_password(self, user_id: int, password_hash: str) -> int:
        return self.catalog.update(USERS, F.col("id") == user_id, password_hash=F.lit(password_hash), is_temporary_password=F.lit(False))

    def delete_marks(self, ids: Sequence[int]) -> int:
        return self.catalog.delete(MARKS, self._ids(ids))

    def delete_clients(self, ids: Sequence[int]) -> int:
        return self.catalog.delete(CLIENTS, self._ids(ids))

    def _ids(self, ids: Sequence[int]) -> DataFrame:
        return self.catalog.spark.createDataFrame([(i,) for i in ids], "id long")

    # ------------------------------------------------------------------- reading

    def list_marks(self, q: str | None = None, class_filter: str | None = None, batch: str | None = None, year: str | None = None) -> DataFrame:
        found = search.search(self.marks(), q, class_filter, batch=batch, year=year)
        label = X.display_label(F.lit(None).cast("string"), F.col("batch_number"), F.col("batch_year"), F.col("serial_number"), F.col("id"))
        return found.select("id", label.alias("display_name"), "serial_number", "trademark_name", "class_indices", "applicant_name", F.col("logo_data").isNotNull().alias("has_logo"))

    def text_search(self, words: str | None = None, class_filter: str | None = None) -> DataFrame:
        return search.listed(search.search(self.marks(), words, class_filter), "serial_number", "trademark_name", "class_indices", "applicant_name", "description")

    def search_clients(self, q: str | None = None) -> DataFrame:
        return search.search_clients(self.clients(), q)

    def image_search(self, vector: Sequence[float], words: str | None = None, class_filter: str | None = None, k: int = IMAGE_K, distance: float = IMAGE_DISTANCE) -> DataFrame:
        """Marks whose logo is near enough among the k nearest; other filters come after the k are taken."""
        near = knn.nearest(knn.usable(self.marks().select("id", "logo_embedding"), "logo_embedding"), vector, k, vector="logo_embedding")
        found = knn.ranked(knn.within(near, distance)).select("id", "rank")
        return J.reordered(search.search(self.marks(), words, class_filter), found)

    def corpus(self, target: str) -> DataFrame:
        """What queries are compared with: all clients, or the marks of a category."""
        if target.upper() == CLIENT:
            c = self.clients().where(F.col("logo_embedding").isNotNull())
            return c.select("id", F.col("file_name").alias("serial_number"), F.col("applicant_name").alias("trademark_name"), "applicant_name", "description", F.lit(None).cast("string").alias("class_indices"), F.lit("Client Record").alias("agent_details"), "logo_data", F.lit(None).cast("array<float>").alias("text_vec"), F.col("logo_embedding").alias("logo_vec"))
        m = self.marks().where(F.col("category") == target.upper())
        return m.select("id", "serial_number", "trademark_name", "applicant_name", "description", "class_indices", "agent_details", "logo_data", F.col("text_embedding").alias("text_vec"), F.col("logo_embedding").alias("logo_vec"))

    def query_items(self, source: str, embed: Callable[[Column], Column] = E.text_embedding, is_picture: Callable[[Column], Column] = I.is_picture, hashed: Callable[[Column], Column] = I.hash_of) -> DataFrame:
        """What is compared, from the tables: all clients, or the marks of a category.

        Names and descriptions are embedded as a query's text; a client's applicant is its name. The
        logo's vector is the stored one.
        """
        if source.upper() == CLIENT:
            rows = self.clients().select("id", F.lit(None).cast("string").alias("serial_number"), F.col("applicant_name").alias("trademark_name"), F.lit(None).cast("string").alias("applicant_name"), "description", "logo_data", "logo_embedding")
        else:
            rows = self.marks().where(F.col("category") == source).select("id", "serial_number", "trademark_name", F.lit(None).cast("string").alias("applicant_name"), "description", "logo_data", "logo_embedding")
        text = X.embeddable(X.combined(F.col("trademark_name"), F.col("description")))
        logo = F.col("logo_data")
        return rows.select(
            F.col("id").alias("qid"), "serial_number", "trademark_name", "applicant_name", "description", embed(text).alias("text_vec"), F.col("logo_embedding").alias("logo_vec"),
            F.when(logo.isNotNull(), is_picture(logo)).otherwise(False).alias("has_img"), F.when(logo.isNotNull(), hashed(logo)).alias("phash"),
        )

    def compare(self, queries: DataFrame, target: str, hashed: Callable[[Column], Column] = I.hash_of, **how) -> DataFrame:
        """Ranked matches of the queries; pictures are hashed of those rows alone that are candidates."""
        return C.compare(queries, self.corpus(target), phash=F.when(F.col("logo_data").isNotNull(), hashed(F.col("logo_data"))), **how)

    def get_blob(self, kind: str, key: int) -> DataFrame:
        """The stored bytes of a mark's logo or evidence, or of a client's logo."""
        table, column = {"logo": (self.marks(), "logo_data"), "evidence": (self.marks(), "evidence_snapshot"), "client-logo": (self.clients(), "logo_data")}[kind]
        return search.blob(table, key, column)
