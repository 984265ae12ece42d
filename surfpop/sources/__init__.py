"""Readers and writers for meshes, landmarks, images and result tables."""
