"""DataFrame operators over videos, annotations, features, models and predictions."""
