"""Evidence curation as Spark DataFrame operations."""

from .operators.dedupe import dedupe
from .operators.topic_fit import TopicRules
from .plans.candidates import plan_candidates
from .plans.mission import Mission, curate_mission
from .session import configure

__all__ = ["Mission", "TopicRules", "configure", "curate_mission", "dedupe", "plan_candidates"]
