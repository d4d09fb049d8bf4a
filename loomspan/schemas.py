"""Declared schemas of the engine's tables and their fixed vocabularies."""

from __future__ import annotations

TABLES = {
    "novel_text": "novel string, ebook_id int, text string",
    "chapter": "novel string, chapter int, text string",
    "characters": "novel string, character string, slug string",
    "event": "novel string, character string, chapter int, event_id string, description string, characters_involved array<string>, psychological_impact map<string,string>, relationship_changes array<map<string,string>>, intensity string",
    "psych_state": "novel string, character string, chapter int, emotional_state string, relationship_states array<map<string,string>>, change_magnitude string",
    "phase": "phase string, chapter_range array<int>, position_description string, key_moments array<string>",
    "axis": "axis_type string, axis_id string, dimension_label string, axis_name string, pole_start string, pole_end string, confidence string, source string, arc_direction string, source_character string, target_character string, evidence_summary string, trajectory array<struct<phase:string,chapter_range:array<int>,position_description:string,key_moments:array<string>>>, annotation struct<valid_votes:int,n_annotators:int>",
    "critic_verdict": "axis_id string, evaluator string, verdict boolean, reasoning string, citations array<struct<author:string,title:string,year:string,publication:string,url:string,relevance:string,search_url:string>>",
    "annotation_vote": "character string, axis_id string, annotator string, validity string, file_name string",
    "phase_response": "probe_id string, phase_idx int, phase_label string, query_chapter int, gt_action string, gt_speech string, gt_thought string, gt_typicality string, unavailable boolean, retry_count int",
    "chunk": "novel string, chapter int, chunk_idx int, text string, embedding array<float>",
    "chapter_summary": "novel string, chapter int, summary string",
    "response": "trial_id string, novel string, character string, character_slug string, axis_id string, axis_type string, target_character string, probe_id string, probe_type string, phase_idx int, query_chapter int, scenario string, question string, mode string, model string, context_char_len int, prompt_hash string, response string, latency_ms int, error string, ts string, dry_run boolean",
    "eval_record": "novel string, character string, probe_id string, phase_idx int, model string, mode string, scale int, scores map<string,double>, average double, parse_ok boolean, error string",
    "traj_record": "novel string, character string, probe_id string, n_phases int, phase_indices array<int>, model string, mode string, scale int, scores map<string,double>, average double, parse_ok boolean, error string",
    "messages": "messages array<struct<role:string,content:string>>",
    "pair_manifest": "probe_id string, phase_idx int, arc_mode string, other_mode string",
    "release_manifest": "repo_id string, revision string, files map<string,struct<size:long,sha256:string>>",
}
#: Vocabularies in their order: fixed values.
MODES = ("vanilla", "summary", "rag", "lifechoice", "timechara", "arc")
PROBE_TYPES = ("in_text", "in_world", "out_of_world")
RESPONSE_DIMS = ("apf", "rpf", "rae")
TRAJECTORY_DIMS = ("ptf_alignment", "ptf_direction", "ptf_shape")
SCALE = 100
