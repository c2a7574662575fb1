"""The models: staging, dimensions and facts, marts, and how they hang together."""
