"""One store for a project's graph: entities, edges and mentions, read and changed through one object.

Tables are DataFrames of one tenant scope; a change returns a new store, so a plan over it
stays declarative and a failed change leaves the old store as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, retrieval, upsert


@dataclass(frozen=True)
class GraphStore:
    """``entities`` (organization_id, project_id, id, name, entity_type, summary), ``edges`` (id, source_id,
    target_id, relationship_type, confidence, created_at, valid_from, valid_to, invalid_at), ``links``
    (episode_id, entity_id), ``episodes`` (id, session_id, created_at) and ``observations``."""

    entities: DataFrame
    edges: DataFrame
    links: DataFrame | None = None
    episodes: DataFrame | None = None
    observations: DataFrame | None = None

    # entities

    def create_entities(self, batch: DataFrame) -> GraphStore:
        return replace(self, entities=upsert.upsert_entities(self.entities, batch).drop("action"))

    def get_entity(self, entity_id: object) -> DataFrame:
        return self.entities.where(F.col("id") == entity_id)

    def delete_entity(self, entity_id: object) -> GraphStore:
        gone = (F.col("source_id") == entity_id) | (F.col("target_id") == entity_id)
        return replace(self, entities=self.entities.where(F.col("id") != entity_id), edges=self.edges.where(~gone))

    def update_entities(self, updates: DataFrame, columns: list[str]) -> GraphStore:
        return replace(self, entities=upsert.apply_updates(self.entities, updates, "id", columns))

    def list_entities(self, types: list[str] | None = None) -> DataFrame:
        out = self.entities if types is None else self.entities.where(F.col("entity_type").isin(types))
        return out.orderBy("name", "id")

    all_entities = list_entities

    def search_entities(self, query: str, types: list[str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        return retrieval.search_entities(self.entities, query, types, limit, offset)

    def bulk_search_entities(self, query: str, threshold: float = 0.3, limit: int = 50) -> DataFrame:
        return retrieval.fuzzy_entities(self.entities, query, threshold, limit)

    def resolve_names(self, ids: DataFrame) -> DataFrame:
        return self.entities.join(ids.select("id").distinct(), "id", "left_semi").select("id", "name", "entity_type")

    def merge(self, mapping: DataFrame) -> GraphStore:
        entities, edges, _ = graph.merge_entities(self.entities, self.edges, mapping)
        return replace(self, entities=entities.where("not is_merged").drop("is_merged"), edges=edges)

    # edges

    def create_edges(self, batch: DataFrame, now: Column) -> GraphStore:
        return replace(self, edges=upsert.upsert_edges(self.edges, batch, now))

    def bulk_edges(self, batch: DataFrame) -> DataFrame:
        return upsert.bulk_edges(self.edges, batch)

    def all_edges(self) -> DataFrame:
        return graph.all_active(self.edges)

    def list_edges(self, entity_id: object, predicate: str | None = None, limit: int = 50, last: list[object] | None = None) -> DataFrame:
        mine = self.edges.where((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id))
        return graph.listing(mine if predicate is None else mine.where(F.col("relationship_type") == predicate), limit, last)

    def entity_with_edges(self, entity_id: object) -> DataFrame:
        return graph.entity_with_edges(self.get_entity(entity_id), graph.live_edges(self.edges))

    def edge_ids_between(self) -> DataFrame:
        return graph.edge_ids_between(graph.live_edges(self.edges))

    def expire_edge(self, edge_id: object, at: Column) -> GraphStore:
        hit = (F.col("id") == edge_id) & F.col("invalid_at").isNull()
        return replace(self, edges=self.edges.withColumn("invalid_at", F.when(hit, at).otherwise(F.col("invalid_at"))))

    def expire_matching(self, commands: DataFrame, at: Column) -> GraphStore:
        return replace(self, edges=graph.expire(self.edges, commands, at))

    # traversal

    def traverse(self, seeds: DataFrame, depth: int = 2, types: list[str] | None = None, as_of: Column | None = None, direction: str = "both") -> DataFrame:
        return graph.bfs(graph.live_edges(self.edges, as_of, types), seeds, depth, direction)

    def retrieve(self, query: str, seeds: int = 5, depth: int = 2, limit: int = 50, as_of: Column | None = None, mode: str = "nearest") -> DataFrame:
        return graph.retrieve(self.entities, self.edges, query, seeds, depth, limit, as_of, mode)

    # mentions

    def link(self, batch: DataFrame) -> GraphStore:
        new = upsert.insert_missing(self.links, batch, ["episode_id", "entity_id"])
        return replace(self, links=self.links.unionByName(new.select(*self.links.columns)))

    def session_entities(self, session_id: object) -> DataFrame:
        return graph.session_entities(self.episodes.where(F.col("session_id") == session_id), self.links, self.entities)

    def co_occurring_pairs(self, least: int = 3) -> DataFrame:
        return graph.co_occurrence(self.links, least)

    def linked_episodes(self) -> DataFrame:
        return graph.linked_episodes(self.links)

    def appearances(self) -> DataFrame:
        return graph.appearances(self.links, self.episodes)

    # observations

    def upsert_observations(self, batch: DataFrame) -> GraphStore:
        return replace(self, observations=upsert.upsert_observations(self.observations, batch))

    def list_observations(self, kind: str | None = None) -> DataFrame:
        return self.observations if kind is None else self.observations.where(F.col("observation_type") == kind)

    def healthy(self) -> bool:
        """Whether the tables can be read; looks at one row of each at most."""
        try:
            for df in (self.entities, self.edges):
                df.limit(1).collect()
        except PySparkException:
            return False
        return True
