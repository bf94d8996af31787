"""The query model, its front ends and its one compiler to DataFrame expressions."""
